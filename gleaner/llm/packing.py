"""Best-fit packing of token sequences, planned on the histogram of lengths.

Every document becomes ids + one separator id, and only documents longer than a sequence are cut.
The plan is made over counts: for each length, from the longest, the pieces of that length go to the
fullest open sequences that hold them; sequences of equal fill are one entry of the plan, so
planning costs the same for a thousand and for a trillion pieces. The plan is a table of slot runs
("ranks r to r+n of length L go to sequences s to s+n at offset o"), at most a few tens of thousands
of rows for any input (bounded by the sequence length, not by the data). Pieces get a rank within
their length, counted per salted cell so that a very common length is no bottleneck, and take the
slot that their rank names.

Defined cases: a null or empty text is the separator alone; empty tables give empty results; extra
columns are ignored; rows that repeat a doc_id are packed each on its own.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from gleaner.llm.common import Workspace, ship, table

_BATCH_CHARS = 8 << 20
_encoders: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(sent):
    """The encoder of a broadcast vocabulary file (its text), once a Python worker."""
    from gleaner.llm.bpe import WordBpe

    key = hash(sent.value)
    if key not in _encoders:
        _encoders[key] = WordBpe(sent.value)
    return _encoders[key]


def _cut(sent, size: int, sep: int, keep_ids: bool):
    def pieces(ids_, texts):
        flat, counts = _encoder(sent).encode(texts)
        at, rows = 0, []
        for doc, n in zip(ids_, counts.tolist()):
            own = np.append(flat[at : at + n], np.uint32(sep)).astype("<u4")
            at += n
            for k, lo in enumerate(range(0, len(own), size)):
                p = own[lo : lo + size]
                rows.append((doc, k, lo, len(p), zlib.crc32(p.tobytes()), p if keep_ids else None))
        cols = list(zip(*rows)) or [[]] * 6
        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            arrays.append(pa.array([x.tolist() for x in cols[5]], pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        ids_, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids_.append(i)
                texts.append(t)
                held += len(t or "")
                if held > _BATCH_CHARS or len(ids_) >= 100_000:
                    yield pieces(ids_, texts)
                    ids_, texts, held = [], [], 0
        if ids_:
            yield pieces(ids_, texts)

    return run


def plan_slots(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, run, first sequence, offset) rows."""
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of sequences (first, n)
    rooms: list[int] = []  # sorted rooms with runs
    slots, new = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if not open_[room]:
                bisect.insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                break
            room = rooms[at]
            first, n = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            t = min(n, left)
            slots.append((length, rank, t, first, size - room))
            put(room, first + t, n - t)
            put(room - length, first, t)
            rank, left = rank + t, left - t
        each = size // length
        for per, n in ((each, left // each), (left % each, 1 if left % each else 0)):
            if n:
                for k in range(per):
                    slots.append((length, rank, n, new, k * length))
                    rank += n
                put(size - per * length, new, n)
                new += n
    return slots


def _take(plan):
    def run(batches):
        length, first, seq, offset = plan.value
        key = length.astype(np.int64) << 44 | first
        for b in batches:
            k = b.column("length").to_numpy().astype(np.int64) << 44 | b.column("rank").to_numpy()
            at = np.searchsorted(key, k, side="right") - 1
            b = b.append_column("sequence_id", pa.array(seq[at] + (k - key[at])))
            yield b.append_column("offset", pa.array(offset[at])).drop_columns(["rank"])

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, separator: int = 0,
    vocabulary: str | None = None, keep_ids: bool = False, cell_rows: int = 256,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``)."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "pack")
    # a file of fixed size; executors need not have it
    sent = spark.sparkContext.broadcast(open(vocabulary or default_vocabulary(), encoding="utf-8").read())
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    pieces = ws.write(src.mapInArrow(_cut(sent, size, separator, keep_ids), schema), "pieces")
    # at most ``size`` lengths: the only thing the driver gathers
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = np.array(sorted(plan_slots(counts, size)) or np.zeros((0, 5)), np.int64)
    plan = spark.sparkContext.broadcast((slots[:, 0], slots[:, 1], slots[:, 3], slots[:, 4]))
    cells = min(1 << 15, max(1, -(-max(counts.values(), default=1) // cell_rows)))
    salted = pieces.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)).cast("int"))
    sizes = salted.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Win.partitionBy("length").orderBy("_cell")) - F.col("_n")).drop("_n")
    in_cell = salted.withColumn("_r", F.row_number().over(Win.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = in_cell.join(before, ["length", "_cell"]).withColumn("rank", (F.col("_before") + F.col("_r") - 1).cast("long"))
    names = pieces.columns
    return ranked.select(*names, "rank").mapInArrow(_take(plan), schema + ", sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
