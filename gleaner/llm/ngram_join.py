"""Exact Jaccard self-join of word n-gram sets by universe partition and pigeonhole.

Two sets of sizes s and t with Jaccard of at least J differ in at most H = (s+t)(1-J)/(1+J) elements. The
universe of shingles is cut by hash into segments, as many as the size band needs, and each segment gets an
allocation: 1 (equal contents match) or 2 (contents that differ in one element match too, by
indexing every one-deletion of the segment). If the allocations sum to H+1, any two similar sets
match in some segment. How many segments get a 2 is chosen for each band by cost: keys to index against
chance matches expected among the band's sets. Matches are verified on whole sets.

Equal sets are one class from the start, and only classes take part. Keys go to buckets as packed
runs, which answer one bit a key ("it occurs elsewhere too"); only keys that repeat become rows. Groups
that share a key are not paired out: each member is compared with one leader, then, where a group
still falls into several components, with its other leaders, and at last across components only.
There, a parity sketch (each element flips one of 2,048 bits) goes before: two sketches never differ in
more bits than the sets do in elements, so a larger difference excludes a pair without loss.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; without words or
null it has no shingle and links with nothing; rows that repeat an id are one vertex; rows without id get
no component and link with nothing; extra columns are ignored (kept by ``near_dedup``); empty tables give
empty results.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import units as U
from gleaner.llm import words as W
from gleaner.llm.common import Workspace, buckets_for, ship, table
from gleaner.llm.graph import components

_U = np.uint64
_RATIO = 1.3  # of a band's largest to its smallest size
_NULL_ID = -(2**63)
_SKETCH = 2048  # bits


class Sets:
    """Shingle sets of one unit's documents, as flat arrays: ``flat[at[i]:at[i+1]]`` is document i's."""

    def __init__(self, payload: bytes, width: int):
        t = U.open_unit(payload)
        self.ids = np.array([_NULL_ID if i is None else i for i in t.column("doc_id").to_pylist()], np.int64)
        raw = [x.encode("utf-8", "surrogatepass") if x else b"" for x in t.column("text").to_pylist()]
        words, counts = W.hash_texts(raw, lower=True)
        starts = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(counts)), counts)
        left = counts[doc] - (np.arange(len(words)) - starts[doc])
        full = np.flatnonzero(left >= width)
        parts, owners = [W.window_hashes(words, width)[full]] if len(full) else [], [doc[full]] if len(full) else []
        for n in range(1, width):
            few = np.flatnonzero(counts == n)
            if len(few):
                parts.append(W.window_hashes(words, n)[starts[few]])
                owners.append(few)
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        d = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        self.flat, self.doc = h[new], d[new]
        self.n = np.bincount(self.doc, minlength=len(counts))
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        # two order-free prints of each set
        self.prints = []
        for mul in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
            acc = np.concatenate([[_U(0)], np.cumsum(W._mix(self.flat * _U(mul)))])
            self.prints.append(W._mix((acc[self.at[1:]] - acc[self.at[:-1]]) + self.n.astype(np.uint64)))

    def sketches(self, docs: np.ndarray) -> np.ndarray:
        """Parity sketches of documents: rows of 64-bit words."""
        slot = np.full(len(self.n), -1)
        slot[docs] = np.arange(len(docs))
        e = np.flatnonzero(slot[self.doc] >= 0)
        bit = (W._mix(self.flat[e] ^ _U(0x5DEECE66D)) % _U(_SKETCH)).astype(np.int64)
        odd = np.bincount(slot[self.doc[e]] * _SKETCH + bit, minlength=len(docs) * _SKETCH) & 1
        return np.packbits(odd.astype(np.uint8)).reshape(len(docs), -1).view(np.int64)

    def keys(self, bands: list[tuple[int, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Index keys of all documents and the document of each."""
        keys, docs = [], []
        for b, (lo, hi, m, deep, slack) in enumerate(bands):
            own = np.flatnonzero((self.n >= lo) & (self.n <= hi))
            if not len(own):
                continue
            slot = np.full(len(self.n), -1)
            slot[own] = np.arange(len(own))
            e = np.flatnonzero(slot[self.doc] >= 0)
            x = self.flat[e]
            seg = (W._mix(x ^ _U(b + 1)) % _U(m)).astype(np.int64)
            cell = slot[self.doc[e]] * m + seg
            x = W._mix(x * _U(0xD1342543DE82EF95))
            total = np.zeros(len(own) * m, np.uint64)
            np.add.at(total, cell, x)
            salt = W._mix(np.arange(m, dtype=np.uint64) + _U((b + 1) << 32))
            # empty segments are no keys, unless the document has more of them than the band allows for
            full = (np.bincount(cell, minlength=len(total)) > 0).reshape(-1, m)
            full[:, :deep] = True
            full[(~full).sum(axis=1) > slack] = True
            full = full.ravel()
            keys.append(W._mix(total + np.tile(salt, len(own)))[full])
            docs.append(np.repeat(own, m)[full])
            one = seg < deep
            if one.any():
                keys.append(W._mix(total[cell[one]] - x[one] + salt[seg[one]]))
                docs.append(self.doc[e][one])
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(keys), np.concatenate(docs)


def plan_bands(sizes: dict[int, int], percent: int, pair_cost: float = 5.0, common: float = 0.01) -> list[tuple[int, int, int, int, int]]:
    """For each size band: smallest and largest size that indexes in it, segments, how many of these have allocation 2, slack.

    ``sizes`` is the histogram of set sizes over all classes. A band indexes its own sets and the larger
    ones that these can match. Segments that are empty would match without meaning anything, so they are
    no keys; ``slack`` more of allocation makes up for as many of them (a document with more indexes them
    after all, and two similar documents with at most ``slack`` in one of them still meet elsewhere).
    Cost of t deep segments: keys a set, plus ``pair_cost`` for each chance match of two of the band's sets; by
    chance match segments whose one element (or, deep, whose elements but one) is common to many texts.
    """
    if not sizes:
        return []
    bands, lo, top = [], 1, max(sizes)
    while lo <= top:
        hi = max(lo, math.ceil(lo * _RATIO) - 1)
        reach = hi * 100 // percent
        most = (hi + reach) * (100 - percent) // (100 + percent)
        if most:
            n = sum(k for s, k in sizes.items() if lo <= s <= reach)
            best = None
            for deep in range(0, (most + 1) // 2 + 1):
                slack = 0
                for _ in range(6):
                    m = most + 1 + slack - deep
                    z = (m - deep) * math.exp(-lo / m)
                    slack = math.ceil(z + 3 * math.sqrt(z)) if z > 0.01 else 0
                m = most + 1 + slack - deep
                if m < max(1, deep):
                    continue
                e = lo / m
                p0, p1 = common * e * math.exp(-e), common * e * (1 + e) * math.exp(-e)
                cost = m + deep * e + pair_cost * n * ((m - deep) * p0 * p0 + deep * min(1, p1) ** 2)
                if best is None or cost < best[0]:
                    best = (cost, m, deep, slack)
            bands.append((lo, reach, *best[1:]))
        lo = hi + 1
    return bands


def _digests(width: int):
    def run(batches):
        for b in batches:
            for unit, payload in zip(b.column("unit").to_pylist(), b.column("payload").to_pylist()):
                s = Sets(payload, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([unit] * len(s.ids), pa.int64()), pa.array(np.arange(len(s.ids))), pa.array(s.ids, mask=s.ids == _NULL_ID), pa.array(s.n), pa.array(s.prints[0].view(np.int64)), pa.array(s.prints[1].view(np.int64))],
                    names=["unit", "i", "doc_id", "n", "p1", "p2"],
                )

    return run


def _entries(s: Sets, bands):
    """Distinct keys of a unit, sorted; whether several of its classes have one; each key's entry and document."""
    k, d = s.keys(bands)
    p = s.prints[0][d]
    order = np.lexsort((p, k))
    k, p, d = k[order], p[order], d[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    entry = np.cumsum(new) - 1
    several = np.zeros(int(new.sum()), bool)
    several[entry[1:][(k[1:] == k[:-1]) & (p[1:] != p[:-1])]] = True
    return k[new], several, entry, k, d


def _cut(k: np.ndarray, buckets: int):
    b = (k % _U(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    present, at = np.unique(b[order], return_index=True)
    return order, present, np.append(at, len(order))


def _send(width: int, bands, buckets: int):
    def run(batches):
        for b in batches:
            for unit, payload in zip(b.column("unit").to_pylist(), b.column("payload").to_pylist()):
                k, several, _, _, _ = _entries(Sets(payload, width), bands)
                order, present, at = _cut(k, buckets)
                k, several = k[order], several[order]
                spans = list(zip(at[:-1], at[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(present), pa.array([unit] * len(present), pa.int64()), pa.array([U.planes(k[i:j] >> _U(24), 5) for i, j in spans], pa.binary()), pa.array([U.bits(several[i:j]) for i, j in spans], pa.binary())],
                    names=["bucket", "unit", "k", "several"],
                )

    return run


def _answer(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """One bit a key: another unit has it too, or several classes of one unit have it.

    Copies of one class in two units raise the bit for nothing; the groups that follow see one member.
    """
    runs = [U.unplanes(x, 5) for x in t.column("k").to_pylist()]
    sizes = [len(x) for x in runs]
    k = np.concatenate(runs)
    several = np.concatenate([U.unbits(x, n) for x, n in zip(t.column("several").to_pylist(), sizes)])
    order = np.argsort(k, kind="stable")
    same = k[order[1:]] == k[order[:-1]]
    several[order[1:]] |= same
    several[order[:-1]] |= same
    parts = np.split(several, np.cumsum(sizes)[:-1])
    return pa.table({"unit": t.column("unit"), "bucket": t.column("bucket"), "mask": pa.array([U.bits(x) for x in parts], pa.binary()), "reps": pa.array([None] * len(parts), pa.list_(pa.int64()))})


def _candidates(width: int, bands, buckets: int):
    def run(key: tuple[pa.Scalar, ...], own: pa.Table, answers: pa.Table) -> pa.Table:
        kind = pa.list_(pa.int64())
        empty = pa.table({"v": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "keys": pa.array([], kind), "grams": pa.array([], kind), "sketch": pa.array([], kind)})
        reps = [r for r in answers.column("reps").to_pylist() if r]
        if not own.num_rows or not reps:
            return empty
        s = Sets(own.column("payload")[0].as_py(), width)
        k, _, entry, keys, docs = _entries(s, bands)
        order, present, at = _cut(k, buckets)
        shared = np.zeros(len(k), bool)
        masks = dict(zip(answers.column("bucket").to_pylist(), answers.column("mask").to_pylist()))
        for b, i, j in zip(present.tolist(), at[:-1], at[1:]):
            if b in masks:
                shared[order[i:j]] = U.unbits(masks[b], j - i)
        is_rep = np.zeros(len(s.ids), bool)
        is_rep[np.array(sum(reps, []), np.int64)] = True
        hit = shared[entry] & is_rep[docs]
        keys, docs = keys[hit], docs[hit]
        by = np.argsort(docs, kind="stable")
        keys, docs = keys[by].view(np.int64), docs[by]
        have, cut = np.unique(docs, return_index=True)
        if not len(have):
            return empty
        runs = np.split(keys, cut[1:])
        return pa.table({
            "v": pa.array(s.ids[have]), "n": pa.array(s.n[have]), "keys": pa.array([np.unique(r) for r in runs], kind),
            "grams": pa.array([s.flat[s.at[i] : s.at[i + 1]].view(np.int64) for i in have], kind), "sketch": pa.array(list(s.sketches(have)), kind),
        })

    return run


def _apart(x: str, y: str):
    """Bits in which two parity sketches differ: at most the elements in which the sets differ."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(_SKETCH // 64)), F.lit(0))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b): those whose sets are similar enough.

    Sketches, which are small, go first; whole sets travel only for the pairs that these leave.
    """
    sketch = sets.groupBy("v").agg(F.first("sketch").alias("sketch"), F.first("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    x = pairs.join(sketch.select(*[F.col(c).alias(f"{c}_a") for c in sketch.columns]).withColumnRenamed("v_a", "a"), "a")
    x = x.join(sketch.select(*[F.col(c).alias(f"{c}_b") for c in sketch.columns]).withColumnRenamed("v_b", "b"), "b")
    room = (F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent)
    # an id that stands for several texts has no one sketch
    x = x.where((_apart("sketch_a", "sketch_b") <= room) | (F.col("texts_a") > 1) | (F.col("texts_b") > 1)).select("a", "b")
    grams = sets.select("v", "grams")
    x = x.join(grams.select(F.col("v").alias("a"), F.col("grams").alias("ga")), "a")
    x = x.join(grams.select(F.col("v").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - F.col("common")
    return x.withColumn("common", common).where(100 * F.col("common") >= percent * union).select("a", "b")


def link_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link at a Jaccard of ``percent`` / 100."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "ngram")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    units = U.make_units(src, ws)
    chars = U.total_chars(units)
    digests = ws.write(units.mapInArrow(_digests(width), "unit long, i long, doc_id long, n long, p1 long, p2 long"), "digests")
    # a class is named by its smallest id; the place of that row in its unit finds it again
    live = digests.where("n > 0 and doc_id is not null")
    classes = live.groupBy("p1", "p2", "n").agg(F.min(F.struct("doc_id", "unit", "i")).alias("m"))
    classes = ws.write(classes.select("p1", "p2", "n", F.col("m.doc_id").alias("rep"), "m.unit", "m.i"), "classes")
    # sizes above 64 are rounded up to a 16th of an octave: the histogram grows with the logarithm of the
    # longest text only
    octave = F.ceil(F.log2("n") * 16)
    size = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.ceil(F.pow(F.lit(2.0), octave / 16)))
    sizes = {r["s"]: r["k"] for r in classes.groupBy(size.cast("long").alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()}
    bands = plan_bands(sizes, percent)
    component = None
    if bands:
        component = _components(spark, ws, units, classes, bands, buckets_for(chars / 6 * 0.25), width, percent)
    out = digests.join(classes.select("p1", "p2", "n", "rep"), ["p1", "p2", "n"], "left")
    rep = F.coalesce(F.when(F.col("n") > 0, F.col("rep")), F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), rep).alias("rep"))
    if component is None:
        return out.withColumnRenamed("rep", "component_id")
    out = out.join(component.select(F.col("v").alias("rep"), "c"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("c", "rep").alias("component_id"))


def _components(spark, ws: Workspace, units: DataFrame, classes: DataFrame, bands, buckets: int, width: int, percent: int) -> DataFrame:
    """(v, c) of the classes that link: verified edges and their connected components."""
    sent = units.mapInArrow(_send(width, bands, buckets), "bucket long, unit long, k binary, several binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "unit long, bucket long, mask binary, reps array<long>")
    reps = classes.groupBy("unit").agg(F.collect_list("i").alias("reps"))  # at most a unit's rows
    answers = answers.unionByName(reps.select("unit", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("mask"), "reps"))
    sets = units.select("unit", "payload").groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(
        _candidates(width, bands, buckets), "v long, n long, keys array<long>, grams array<long>, sketch array<long>"
    )
    sets = ws.write(sets, "sets")
    ws.drop("units")  # nothing reads them any more
    keys = sets.select(F.explode("keys").alias("k"), "v", "n")
    near = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)

    # each member against the leader (smallest id) that it shares most keys with
    leaders = keys.groupBy("k").agg(F.min(F.struct("v", "n")).alias("l"))
    led = keys.join(leaders, "k").where((F.col("v") != F.col("l.v")) & near(F.col("n"), F.col("l.n")))
    votes = led.groupBy(F.col("v").alias("a"), F.col("l.v").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
    pairs = votes.groupBy("a").agg(F.max(F.struct("votes", (-F.col("b")).alias("less"))).alias("m")).select("a", (-F.col("m.less")).alias("b"))
    tested = ws.write(pairs, "pairs1")
    edges = ws.write(_verified(tested, sets, percent), "edges1")
    comp = components(edges, ws, "cc1")

    def open_keys(comp: DataFrame) -> DataFrame:
        """Keys whose members are still in several components, with these."""
        named = keys.join(comp, "v", "left").select("k", "v", "n", F.coalesce("c", "v").alias("c"))
        split = named.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("k")
        return named.join(split, "k", "left_semi")

    # where a group is still split, members against the group's own leader
    left = ws.write(open_keys(comp), "open2")
    leaders = left.groupBy("k").agg(F.min(F.struct("v", "n", "c")).alias("l"))
    led = left.join(leaders, "k").where((F.col("c") != F.col("l.c")) & near(F.col("n"), F.col("l.n")))
    pairs = led.select(F.col("v").alias("a"), F.col("l.v").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    pairs = ws.write(pairs, "pairs2")
    found = ws.write(_verified(pairs, sets, percent), "edges2")
    tested, edges = tested.unionByName(pairs), edges.unionByName(found)
    if not found.isEmpty():
        comp = components(edges, ws, "cc2")
        left = ws.write(open_keys(comp), "open3")

    # at last everything across components: members outside a group's largest component against the rest
    sizes = left.groupBy("k", "c").agg(F.count(F.lit(1)).alias("s")).groupBy("k").agg(F.max(F.struct("s", "c")).alias("m"))
    marked = left.join(sizes.select("k", F.col("m.c").alias("big")), "k").withColumn("minor", F.col("c") != F.col("big"))
    marked = marked.join(sets.groupBy("v").agg(F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("texts")), "v")
    one, two = marked.where("minor").alias("x"), marked.alias("y")
    apart = _apart("x.sketch", "y.sketch")
    room = (F.col("x.n") + F.col("y.n")) * (100 - percent) / (100 + percent)
    across = (F.col("x.c") != F.col("y.c")) & near(F.col("x.n"), F.col("y.n")) & (~F.col("y.minor") | (F.col("x.v") < F.col("y.v")))
    # an id that stands for several texts has no one sketch
    across = across & ((apart <= room) | (F.col("x.texts") > 1) | (F.col("y.texts") > 1))
    pairs = one.join(two, (F.col("x.k") == F.col("y.k")) & across).select(F.greatest("x.v", "y.v").alias("a"), F.least("x.v", "y.v").alias("b"))
    pairs = ws.write(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs3")
    found = ws.write(_verified(pairs, sets, percent), "edges3")
    if not found.isEmpty():
        comp = components(edges.unionByName(found), ws, "cc3")
    return comp


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row (the smallest id, null ids last) of each component.

    Where ids repeat or are null, rows are numbered and linked by number, so that each row is judged by its own text.
    """
    again = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(id_col).isNull())
    if again.isEmpty():
        linked = link_components(docs, width, percent, id_col, text_col)
        gone = linked.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
    ws, row = Workspace(docs.sparkSession, "near"), "_row_" + uuid.uuid4().hex[:8]
    rows = ws.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    linked = link_components(rows, width, percent, row, text_col)
    ids = rows.select(F.col(row).alias("doc_id"), F.col(id_col).alias("id"))
    best = linked.join(ids, "doc_id").groupBy("component_id").agg(F.min_by("doc_id", F.struct(F.col("id").isNull(), "id", "doc_id")).alias(row))
    return rows.join(best.select(row), row, "left_semi").drop(row)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"), width=3, percent=90)
