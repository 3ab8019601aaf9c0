import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from gleaner.llm import exact_dedup, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, unit string, payload string, v long, keys string"  # extra columns with clashing names


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "u", "p", 1, None) for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [words(rng, rng.choice([1, 3, 12, 30, 80, 200])) for _ in range(60)]
    out = base + [base[5], base[6].replace(" ", "  "), base[6] + "\n"]
    for _ in range(60):  # near copies, some by one word
        w = rng.choice(base).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        out.append(" ".join(w))
    passage = words(rng, 30)
    out += [f"{words(rng, 9)} {passage} {words(rng, 5)}" for _ in range(8)] + [None, None, "", " \t", "É", "x y", "x y", "a " * 60]
    return list(enumerate(out))


def test_exact(spark, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best, size = {}, {}
    for i, t in rows:
        k = norm(t)
        size[k] = size.get(k, 0) + 1
        if k not in best or (-len(t or ""), i) < best[k]:
            best[k] = (-len(t or ""), i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        k = norm(t)
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best[k][1], size[k], best[k][1] == i)
        assert r["text_sha256"] == hashlib.sha256(k.encode()).hexdigest()


def test_exact_drop_keeps_columns_and_one_of_repeated_rows(spark):
    df = frame(spark, [(1, "a"), (1, "a"), (2, "a"), (3, None), (None, "b")])
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns and sorted((r["doc_id"] or 0, r["text"]) for r in out.collect() if r["text"]) == [(0, "b"), (1, "a")]


def test_exact_drop_judges_rows_not_ids(spark):
    rows = [(None, "zz"), (None, "q unique"), (5, "zz "), (0, "a"), (1, "a"), (1, "b unique"), (7, "k"), (7, "k "), (None, None), (8, ""), (9, "t"), (9, "t")]
    got = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, "q unique"), (5, "zz "), (0, "a"), (1, "b unique"), (7, "k "), (8, ""), (9, "t")], key=str)


def test_near_drop_judges_rows_not_ids(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(1, t), (1, "quite another text of its own with many words"), (None, t), (2, t + " "), (None, "yet something else that is not like it at all"), (3, None), (3, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in ngram_join.near_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[4], rows[5], rows[6]], key=str)
    assert ngram_join.near_dedup(frame(spark, [(1, t), (2, t), (3, "x")])).count() == 2


def test_filter_in_slices(spark, rows):
    a = exact_dedup.exact_groups(frame(spark, rows)).toPandas().sort_values("doc_id")
    b = exact_dedup.exact_groups(frame(spark, rows), max_bits=1000).toPandas().sort_values("doc_id")
    assert a.reset_index(drop=True).equals(b.reset_index(drop=True))
    c = exact_dedup.exact_dedup(frame(spark, rows), max_bits=1000)
    assert {r["doc_id"] for r in c.collect()} == set(a[a["kept"]]["doc_id"])


def test_cut_keeps_other_white_space(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(1, f"a\n\nb {passage}\nc"), (2, f"x\n\ny  z\t{passage}\n\nend\nof it"), (3, passage)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "x\n\ny  z\tend\nof it", 3: ""}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 60)])
def test_ngram_components(spark, rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(frame(spark, rows), width, percent).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in sets}


def test_bands_cover_all_sizes():
    for percent in (60, 80, 90):
        bands = ngram_join.plan_bands({1: 5, 40: 10**9, 3000: 2}, percent)
        for s in range(1, 3000):
            for t in (s, s * 100 // percent):
                room = (s + t) * (100 - percent) // (100 + percent)
                if room:  # some band indexes both, with allocation beyond the room and the slack
                    assert any(lo <= s and t <= hi and m + deep >= room + 1 + slack for lo, hi, m, deep, slack in bands)


def test_substring(spark, rows):
    seen, want = set(), {}
    for i, t in rows:
        w = (t or "").encode().split()
        drop = [False] * len(w)
        for k in range(len(w) - 19):
            win = tuple(w[k : k + 20])
            if win in seen:
                drop[k : k + 20] = [True] * 20
            seen.add(win)
        want[i] = (len(w), sum(drop), hashlib.sha256(b" ".join(x for x, d in zip(w, drop) if not d)).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_report(frame(spark, rows)).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 0
    out = substring_dedup.dedup_substrings(frame(spark, rows))
    assert [f.name for f in out.schema] == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and out.count() == len(rows)


def test_difference_cover():
    c, m = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % m for a in c for b in c} == set(range(m))


def test_empty_tables(spark):
    none = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert exact_dedup.exact_groups(none).count() == 0
    assert ngram_join.link_components(none).count() == 0
    assert substring_dedup.substring_report(none).count() == 0


def test_vectors_of_extreme_size_link(spark):
    from gleaner.llm.embedding_dedup import near_vectors

    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [1.0, -1.0]), (6, [5e-324, 0.0]), (7, [1e308, 1e300]), (8, [0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_a_crowd_in_one_tile_takes_bounded_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from gleaner.llm.embedding_dedup import _tile

    n, rng = 6000, np.random.default_rng(4)
    x = np.ones(64) + 0.01 * rng.normal(size=(n, 64))
    x[-1] = rng.normal(size=64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = pa.table({"v": pa.array(np.arange(n) + 5), "weight": pa.array(np.ones(n, np.int64)), "u": pa.array([r.tobytes() for r in x], pa.binary())})
    key = tuple(pa.scalar(k) for k in (0, 0, 0))
    tracemalloc.start()
    out = _tile(0.95, 0.95 - 1e-4)(key, t, t).to_pydict()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out["v"]) == n - 1 and set(out["n"]) == {n - 2} and set(out["label"]) == {5} and most < 400e6


def test_exact_groups_of_repeated_and_extreme_ids(spark):
    from gleaner.llm.exact_dedup import exact_dedup, exact_groups

    rows = [(1, "same text"), (1, "same text"), (1, "same text"), (-(2**63), "a b"), (2**63 - 1, "ab"), (None, "a\tb"), (7, "other"), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = exact_groups(df).collect()
    assert sorted(r["kept"] for r in got if r["doc_id"] == 1) == [False, False, True] and len(got) == len(rows)
    keep = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"] != 1}
    assert keep == {-(2**63): (-(2**63), 3, True), 2**63 - 1: (-(2**63), 3, False), None: (-(2**63), 3, False), 7: (7, 1, True), 8: (8, 2, True), 9: (8, 2, False)}
    assert sorted(r["doc_id"] for r in exact_dedup(df).collect()) == [-(2**63), 1, 7, 8]


def test_texts_that_do_not_repeat_never_shuffle(spark):
    from gleaner.llm.exact_dedup import exact_dedup

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, f"text {i % 40}") for i in range(60)], "doc_id long, text string")
        out = exact_dedup(df)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        plain, joined = plan.split("SortMergeJoin")[0], plan.split("SortMergeJoin")[1]
        assert out.count() == 40 and "Union" in plain and "Exchange" not in plain.replace("BroadcastExchange", "") and "MapInArrow" in plain and "MapInArrow" in joined
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
