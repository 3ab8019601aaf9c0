"""Exact deduplication: a two-pass Bloom filter finds texts that may repeat; only those shuffle.

Pass one digests every text (whole text, white space removed) and counts the digests in Bloom
cells: a cell is marked when two or more digests fall on it. Pass two tests each digest against the
marks. A text whose cells are not all marked is certainly unique and passes straight through; the
others are grouped by their SHA-256, so false positives of the filter cost a shuffled row and never
change a result.

Bounds: what is broadcast is one bitmap of at most ``max_bits`` (32 MB by default). Where the rows need a larger
filter, digests are dealt into slices by their own value, and the two passes run slice after slice, each with a
bitmap of its own: the method and its memory stay the same for any number of rows.

Defined cases: a null text counts as empty, and so equals every empty or all-blank text; empty
tables give empty results; extra columns are ignored by ``exact_groups`` and kept by
``exact_dedup``; rows are judged each by its own text, whatever their ids; of rows equal in text, length and id one stays; a null doc_id sorts after all others.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import Workspace, chunked, ship, table

_BLANKS = b" \t\n\x0b\x0c\r"
_SEG_BITS = 1 << 19  # one segment of the filter: 64 KB as bits


def _digests_of(texts: list[str | None]) -> tuple[list[bytes], list[int]]:
    return [hashlib.sha256((t or "").encode("utf-8", "surrogatepass").translate(None, _BLANKS)).digest() for t in texts], [len(t or "") for t in texts]


def _digest(slices: int):
    def run(batches):
        for b in chunked(batches, 2048):
            sha, n = _digests_of(b.column(1).to_pylist())
            part = [int.from_bytes(s[24:28], "big") * slices >> 32 for s in sha]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary()), pa.array(n, pa.int64()), pa.array(part, pa.int32())], names=["doc_id", "sha", "n_points", "slice"])

    return run


def _cells(sha: list[bytes], bits: int, k: int = 3) -> np.ndarray:
    """k cells of each digest, from its first 24 bytes."""
    words = np.frombuffer(b"".join(s[: 8 * k] for s in sha), np.uint64).reshape(-1, k)
    return words % np.uint64(bits)


def _emit_cells(bits: int):
    def run(batches):
        for b in chunked(batches, 65536):
            cells = np.sort(_cells(b.column(0).to_pylist(), bits), axis=1)
            # a digest that falls twice on a cell counts there once
            keep = np.ones(cells.shape, bool)
            keep[:, 1:] = cells[:, 1:] != cells[:, :-1]
            flat = np.sort(cells[keep])
            seg = (flat // np.uint64(_SEG_BITS)).astype(np.int64)
            cut = np.flatnonzero(np.diff(seg, prepend=-1))
            parts = np.split((flat % np.uint64(_SEG_BITS)).astype(np.uint32), cut[1:])
            if len(flat):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg[cut]), pa.array([p.tobytes() for p in parts], pa.binary())], names=["seg", "cells"]
                )

    return run


def _mark(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Bits of a segment's cells on which two or more digests fell."""
    once, twice = np.zeros(_SEG_BITS, bool), np.zeros(_SEG_BITS, bool)
    for raw in t.column("cells").to_pylist():
        c = np.frombuffer(raw, np.uint32)
        c, n = np.unique(c, return_counts=True)
        twice[c] |= once[c] | (n > 1)
        once[c] = True
    bits = np.packbits(twice).tobytes()
    return pa.table({"seg": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits], pa.binary())})


def _hits(sha: list[bytes], bits: int, marks: bytes) -> np.ndarray:
    c, m = _cells(sha, bits), np.frombuffer(marks, np.uint8)
    return ((m[(c >> np.uint64(3)).astype(np.int64)] >> (7 - (c & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def _test(bits: int, marks):
    def run(batches):
        at = int.from_bytes(os.urandom(8), "big") >> 2  # rows are told apart by a number that is written with them
        for b in chunked(batches, 65536):
            rows = pa.array(np.arange(at, at + b.num_rows, dtype=np.int64))
            at += b.num_rows
            yield b.append_column("maybe", pa.array(_hits(b.column("sha").to_pylist(), bits, marks.value))).append_column("row", rows)

    return run


_DIGESTS = "doc_id long, sha binary, n_points long, slice int"


def _tested(src: DataFrame, ws: Workspace, bits_per_text: int, max_bits: int) -> DataFrame:
    """doc_id, sha, n_points, maybe, row of every row of ``src`` (doc_id, text)."""
    spark = src.sparkSession
    n = src.count()
    slices = max(1, -(-n * bits_per_text // max_bits))
    bits = max(_SEG_BITS, -(-n * bits_per_text // slices // _SEG_BITS) * _SEG_BITS)
    digests, path = src.mapInArrow(_digest(slices), _DIGESTS), f"{ws.base}/tested"
    if slices > 1:  # a folder a slice, so that each round reads its own only
        digests.write.partitionBy("slice").parquet(f"{ws.base}/digests")
        digests = spark.read.schema(_DIGESTS).parquet(f"{ws.base}/digests").select("doc_id", "sha", "n_points", "slice")
    else:
        digests = ws.write(digests, "digests")
    for k in range(slices):
        own = digests.where(F.col("slice") == k)
        sent = _marks(own.select("sha").mapInArrow(_emit_cells(bits), "seg long, cells binary"), _mark, bits)
        own.mapInArrow(_test(bits, sent), _DIGESTS + ", maybe boolean, row long").write.mode("append").parquet(path)
        sent.destroy()
    ws.drop("digests")
    return spark.read.schema(_DIGESTS + ", maybe boolean, row long").parquet(path)


def _groups(tested: DataFrame, ws: Workspace) -> DataFrame:
    """sha, keep_id, keep_points, keep_row, group_size of digests that several rows have."""
    best = F.max_by(F.struct("doc_id", "n_points", "row"), F.struct("n_points", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"), "row"))
    groups = tested.where("maybe").groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return ws.write(groups.select("sha", F.col("best.doc_id").alias("keep_id"), F.col("best.n_points").alias("keep_points"), F.col("best.row").alias("keep_row"), "group_size"), "groups")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_text: int = 16, max_bits: int = 1 << 28
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal after deleting white space ([\\x20\\x09-\\x0d]); the one with the most
    code points, then the smallest id, stays.
    """
    ship(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "exact")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tested = _tested(src, ws, bits_per_text, max_bits)
    # groups are few against the rows; Spark broadcasts them only under its size threshold and else
    # sort-merges, where it splits the partition of a very large group
    lone = F.col("group_size").isNull()
    found = tested.where("maybe").join(_groups(tested, ws), "sha", "left").select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (lone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    unique = tested.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
    return unique.unionByName(found)


def _with_digest(text_col: str, sha_col: str, n_col: str, maybe: bool, bits: int, marks):
    """Rows with their digest and length: those whose digest falls on marks, or the others."""

    def run(batches):
        for b in chunked(batches, 2048):
            sha, n = _digests_of(b.column(text_col).to_pylist())
            own = _hits(sha, bits, marks.value) if sha else np.zeros(0, bool)
            out = b.append_column(sha_col, pa.array(sha, pa.binary())).append_column(n_col, pa.array(n, pa.int64()))
            yield out.filter(pa.array(own if maybe else ~own))

    return run


def _set(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Bits of a segment's cells on which any digest fell."""
    on = np.zeros(_SEG_BITS, bool)
    for raw in t.column("cells").to_pylist():
        on[np.frombuffer(raw, np.uint32)] = True
    return pa.table({"seg": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})


def _marks(segs: DataFrame, mark, bits: int):
    marks = bytearray(bits // 8)
    for r in segs.groupBy("seg").applyInArrow(mark, "seg long, bits binary").toLocalIterator():
        marks[r["seg"] * _SEG_BITS // 8 : (r["seg"] + 1) * _SEG_BITS // 8] = r["bits"]
    return segs.sparkSession.sparkContext.broadcast(bytes(marks))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_text: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """``docs`` without the rows whose text equals that of a row that stays (see ``exact_groups``).

    A filter over the repeated digests tells which rows may have one: only those are joined with the groups, and the texts of all others never
    shuffle, however many groups there are. Rows are judged by their own digest, never by their id.
    """
    spark = docs.sparkSession
    ship(spark)
    ws, end = Workspace(spark, "exact-drop"), uuid.uuid4().hex[:8]
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tested = _tested(src, ws, bits_per_text, max_bits)
    groups = _groups(tested, ws)
    # rows that tie in text, length and id with the one that stays
    ties = tested.where("maybe").join(groups, "sha").where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")))
    ties = ties.groupBy("sha").agg((F.count(F.lit(1)) > 1).alias("tie"))
    sha, n, keep, points, tie = (f"_{x}_{end}" for x in ("sha", "n", "keep", "points", "tie"))
    named = groups.join(ties, "sha").select(F.col("sha").alias(sha), F.col("keep_id").alias(keep), F.col("keep_points").alias(points), F.col("tie").alias(tie))
    named = ws.write(named, "named")
    bits = max(_SEG_BITS, -(-min(max_bits, named.count() * bits_per_text) // _SEG_BITS) * _SEG_BITS)
    sent = _marks(named.select(F.col(sha).alias("sha")).mapInArrow(_emit_cells(bits), "seg long, cells binary"), _set, bits)
    schema = T.StructType([*docs.schema.fields, T.StructField(sha, T.BinaryType()), T.StructField(n, T.LongType())])
    rows = lambda maybe: docs.mapInArrow(_with_digest(text_col, sha, n, maybe, bits, sent), schema)
    own = [F.col(f"`{c}`") for c in docs.columns]
    stays = F.col(id_col).cast("long").eqNullSafe(F.col(keep)) & (F.col(n) == F.col(points))
    kept = rows(True).join(named, sha, "left").where(F.col(points).isNull() | stays)
    if not named.where(F.col(tie)).isEmpty():
        one = kept.where(F.col(tie)).dropDuplicates([sha])
        kept = kept.where(F.coalesce(~F.col(tie), F.lit(True))).unionByName(one)
    return rows(False).select(*own).unionByName(kept.select(*own))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM g
"""
