"""Photo features of grids of any size, with gaps, against plain loops; photos of one small file are dealt to all cores."""

import random

from pyspark.sql import functions as F

from gleaner.operators import image
from gleaner.plans import queries as Q


def brute_style(g, w, h):
    if w is not None and w < 8 or h is not None and h < 8:
        return False
    if w is None or h is None:
        return None
    ring, n = max(1, int(min(w, h) * 0.12)), {}
    for p in range(w * h):
        rgb = [(g[4 * p + k] if g and 4 * p + k < len(g) else 0) or 0 for k in range(3)]
        edge = not (ring <= p % w < w - ring and ring <= p // w < h - ring)
        key = edge, min(rgb) >= 243 and max(rgb) - min(rgb) <= 12
        n[key] = n.get(key, 0) + 1
    of = lambda e, v: n.get((e, v), 0)
    return of(True, True) / max(1, of(True, True) + of(True, False)) >= 0.92 and of(False, False) / max(1, of(False, True) + of(False, False)) >= 0.08


def test_stock_photos(spark):
    rng = random.Random(3)
    rows = [([], 8, 8), (None, 9, 9), ([250] * 256, None, 8), ([250] * 256, None, 7), ([250] * 256, 8, 8)]
    for _ in range(60):
        w, h = rng.choice([(7, 9), (8, 8), (24, 24), (30, 17)])
        g = [250 if not (3 <= p % w < w - 3 and 3 <= p // w < h - 3) else rng.choice([20, 250]) for p in range(w * h) for _ in range(4)]
        for _ in range(rng.choice([0, 0, 5])):
            g[rng.randrange(len(g))] = rng.choice([0, 242, 243, 255, None])
        rows.append((g[: len(g) - rng.choice([0, 0, 0, 7])], w, h))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g array<int>, w int, h int")
    got = {r["i"]: r["s"] for r in df.select("i", image.catalog_style(F.col("g"), F.col("w"), F.col("h")).alias("s")).collect()}
    assert got == {i: brute_style(*r) for i, r in enumerate(rows)} and set(got.values()) == {True, False, None}


def test_photos_of_one_file_go_to_all_cores(spark, tmp_path):
    spark.createDataFrame([(i, i % 50) for i in range(40)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = Q.catalog_style(spark, str(tmp_path))
    assert out.count() == 40 and out.rdd.getNumPartitions() > 1


def brute_hash(g):
    luma = [None if any(v is None for v in g[4 * p : 4 * p + 3]) or 4 * p + 3 > len(g) else 0.299 * g[4 * p] + 0.587 * g[4 * p + 1] + 0.114 * g[4 * p + 2] for p in range(72)]
    darker = lambda a, b: a is not None and b is not None and a < b
    return f"{int(''.join('01'[darker(luma[9 * y + x], luma[9 * y + x + 1])] for y in range(8) for x in range(8)), 2):016x}"


def test_hashes_of_every_part(spark, tmp_path):
    spark.createDataFrame([(i, i % 50) for i in range(600)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = Q.photo_hash(spark, str(tmp_path))
    want = {i: brute_hash([(k * 37 + i * 11 + k % 4 * (i % 50)) % 251 for k in range(288)]) for i in range(600)}
    assert {r["p_partkey"]: r["dhash"] for r in out.collect()} == want and out.rdd.getNumPartitions() > 1
    gaps = spark.createDataFrame([([1, None] * 144,), (list(range(200)),), ([],)], "g array<int>")
    assert [r[0] for r in gaps.select(image.dhash(F.col("g"))).collect()] == [brute_hash(g) for g in ([1, None] * 144, list(range(200)), [])]
