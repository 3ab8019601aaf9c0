"""Compression of vectors to codes: a codebook for each part of the vectors, learned by heap Lloyd rounds in exact integers.

Vectors become integers (floor of ``scale`` times a component) and are cut into equal parts; each part position has a codebook
of at most ``entries`` entries. A block of vectors keeps, for each position and entry, a heap of the parts assigned to the entry. A
part's key is its lower bound (distance to its second-nearest entry) minus its upper bound (distance to its own) when it was last
looked at. When entries move, an entry's drift grows by its own step plus the largest step of any other; a key minus the
drift since bounds what is left of the slack. Hence a round pops a heap only while its top is violated and rescans just these parts exactly
against all entries, in whole numbers; the others keep their entry, ties to lower indexes included (a slack of ``_EPS`` or less counts as violated).

In Spark: the vectors are packed once into blocks (rows of a table); every round is one narrow pass over the blocks that reads the small
codebooks, writes the next state and emits each task's sums by entry, which are pre-aggregated and summed. Only codebooks and their sums, bounded by
parts x ``entries`` x length, meet on the driver. A state is a table in the shared folder, dropped once the next one is written, so a lost
executor costs its blocks' round. What is left of a heap is a heap: its array is kept as it is.

Defined cases: vectors that are null, empty, or hold nulls or non-finite components are left out; so are vectors of another length than
the commonest one (of equally common ones the largest), and all where that length is no multiple of ``parts``. Scaled components beyond
2**24 in size count as that. Rows that repeat an id are vectors of their own (seeds go by id, then components); rows without id sort last. With fewer
vectors than ``entries`` there are as many entries as vectors. Entries without parts stay. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Workspace, ship, table

_EPS = 1e-3  # of distances between whole vectors, far above the rounding of double precision
_MOST = 1 << 24
_STATE = "kind string, ids array<long>, labels array<{0}>, vectors binary, codes binary, keys binary, heaps binary, sums binary"


def _whole(scale: float, length: int):
    """Rows with usable vectors: ``v`` as packed 32-bit integers."""

    def run(batches):
        for b in batches:
            keep, packed = [], []
            for k, v in enumerate(b.column("v").to_pylist()):
                if v is not None and len(v) == length and None not in v:
                    x = np.array(v, np.float64)
                    if np.isfinite(x).all():
                        with np.errstate(over="ignore"):
                            x = np.clip(np.floor(x * scale), -_MOST, _MOST)
                        keep.append(k)
                        packed.append(x.astype("<i4").tobytes())
            out = b.take(pa.array(keep, pa.int64())).drop_columns(["v"])
            yield out.append_column("x", pa.array(packed, pa.binary()))

    return run


def _blocks(rows: int):
    """Packs a task's vectors into blocks of at most ``rows``; no more than a block is held."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                take = b.slice(0, rows - n)
                held.append(take)
                n, b = n + take.num_rows, b.slice(take.num_rows)
                if n == rows:
                    yield _block(held)
                    held, n = [], 0
        if n:
            yield _block(held)

    return run


def _block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    one = lambda c: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).chunk(0))
    x = np.frombuffer(b"".join(t.column("x").to_pylist()), "<i4")
    small = np.abs(x).max() < 1 << 15
    return _row("block", one("vec_id"), one("label"), pa.array([b"h" + x.astype("<i2").tobytes() if small else b"i" + x.tobytes()], pa.binary()))


def _row(kind, ids, labels, vectors, codes=None, keys=None, heaps=None, sums=None) -> pa.RecordBatch:
    raw = lambda a: pa.array([None if a is None else a.tobytes()], pa.binary())
    names = ["kind", "ids", "labels", "vectors", "codes", "keys", "heaps", "sums"]
    return pa.RecordBatch.from_arrays([pa.array([kind]), ids, labels, vectors, raw(codes), raw(keys), raw(heaps), raw(sums)], names=names)


def unpack(packed: bytes) -> np.ndarray:
    """All components of a block, as doubles (whole numbers)."""
    return np.frombuffer(packed[1:], "<i2" if packed[:1] == b"h" else "<i4").astype(np.float64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part its nearest entry (ties to the lower index), the exact squared distance, and that to the next nearest (inf with one entry)."""
    at, own, other = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    big = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    exact = 4 * big * big * x.shape[1] < 2**53  # products of doubles hold these whole numbers
    for lo in range(0, len(x), 1024):
        y = x[lo : lo + 1024]
        if exact:
            d = (y * y).sum(1)[:, None] - 2 * (y @ book.T) + (book * book).sum(1)
        else:
            d = np.zeros((len(y), len(book)), np.int64)
            for k in range(x.shape[1]):
                d += (y[:, k].astype(np.int64)[:, None] - book[:, k].astype(np.int64)) ** 2
        best, rows = d.argmin(1), np.arange(len(y))
        at[lo : lo + 1024], own[lo : lo + 1024] = best, d[rows, best]
        if len(book) > 1:
            if exact:
                d[rows, best] = np.inf
            else:
                d[rows, best] = np.iinfo(np.int64).max
            other[lo : lo + 1024] = d.min(1)
    return at, own, other


class Heaps:
    """The heaps of one part position of a block: for each entry its parts, the most violated on top."""

    def __init__(self, codes: np.ndarray, keys: np.ndarray, order: np.ndarray | None, entries: int):
        self.codes, self.keys = codes, keys
        if order is None:  # all parts are to be looked at
            self.heaps = [[] for _ in range(entries)]
            return
        bounds = np.searchsorted(codes[order], np.arange(entries + 1))
        pairs = list(zip(keys[order].tolist(), order.tolist()))
        self.heaps = [pairs[lo:hi] for lo, hi in itertools.pairwise(bounds.tolist())]

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """Pops the parts whose slack the drift has used up."""
        out = []
        for heap, moved in zip(self.heaps, drift.tolist()):
            while heap and heap[0][0] - moved <= _EPS:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def rescan(self, which: np.ndarray, x: np.ndarray, book: np.ndarray, drift: np.ndarray) -> None:
        """Assigns the parts anew and pushes them; keys hold the drift of before, so that they can be compared at any time."""
        at, own, other = nearest(x[which], book)
        keys = np.sqrt(other) - np.sqrt(own) + drift[at]
        self.codes[which], self.keys[which] = at, keys
        fresh: dict[int, list] = {}
        for i, e, k in zip(which.tolist(), at.tolist(), keys.tolist()):
            fresh.setdefault(e, []).append((k, i))
        for e, pairs in fresh.items():
            if len(pairs) * 4 > len(self.heaps[e]):
                self.heaps[e] += pairs
                heapq.heapify(self.heaps[e])
            else:
                for p in pairs:
                    heapq.heappush(self.heaps[e], p)

    def order(self) -> np.ndarray:
        """The parts heap by heap, each as its array stands."""
        return np.array([i for heap in self.heaps for _, i in heap], np.int32)


def _round(sent, parts: int, last: bool):
    """One pass: pops and rescans, then the next state of each block and the task's sums; after the last, codes and errors."""

    def assigned(b: pa.RecordBatch, r: int):
        books, drift = sent.value
        n = len(b.column("ids")[r])
        x = unpack(b.column("vectors")[r].as_py()).reshape(n, parts, -1)
        entries = books.shape[1]
        codes, keys, heaps = (b.column(c)[r].as_py() for c in ("codes", "keys", "heaps"))
        first = codes is None
        codes = np.zeros((parts, n), np.int64) if first else np.frombuffer(codes, "<u2").reshape(parts, n).astype(np.int64)
        keys = np.zeros((parts, n)) if first else np.frombuffer(keys, "<f8").reshape(parts, n).copy()
        heaps = None if first else np.frombuffer(heaps, "<i4").reshape(parts, n)
        orders = []
        for p in range(parts):
            h = Heaps(codes[p], keys[p], None if first else heaps[p], entries)
            which = np.arange(n) if first else h.violated(drift[p])
            if len(which):
                h.rescan(which, x[:, p], books[p], drift[p])
            orders.append(h.order())
        return x, codes, keys, np.stack(orders)

    def run(batches):
        books, _ = sent.value
        total = None
        kind = None
        for b in batches:
            kind = b.schema.field("labels").type
            for r in range(b.num_rows):
                x, codes, keys, order = assigned(b, r)
                sums = np.zeros((parts, books.shape[1], books.shape[2] + 1), np.int64)
                for p in range(parts):
                    np.add.at(sums[p, :, 0], codes[p], 1)
                    for k in range(books.shape[2]):
                        sums[p, :, k + 1] = np.bincount(codes[p], x[:, p, k], books.shape[1])
                total = sums if total is None else total + sums
                yield _row("block", *[b.column(c).slice(r, 1) for c in ("ids", "labels", "vectors")], codes.astype("<u2"), keys, order)
        if total is not None:
            yield _row("sums", *[pa.nulls(1, t) for t in (pa.list_(pa.int64()), kind, pa.binary())], sums=total)

    def finish(batches):
        books, _ = sent.value
        for b in batches:
            for r in range(b.num_rows):
                x, codes, _, _ = assigned(b, r)
                error = np.zeros(len(x), np.int64)
                for p in range(parts):
                    error += ((x[:, p] - books[p][codes[p]]).astype(np.int64) ** 2).sum(1)
                digits = np.array([f"{k:02x}" for k in range(books.shape[1])])
                text = digits[codes[0]]
                for p in range(1, parts):
                    text = np.char.add(text, digits[codes[p]])
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids").slice(r, 1).flatten(), b.column("labels").slice(r, 1).flatten(), pa.array(text.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"]
                )

    return finish if last else run


def _add_up(batches):
    """Sums of a task's sums."""
    total = None
    for b in batches:
        for raw in b.column(0).to_pylist():
            x = np.frombuffer(raw, np.int64)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _moved(books: np.ndarray, sums: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next codebooks, and what each entry's bounds have lost so far."""
    n = sums[:, :, :1]
    new = np.where(n > 0, sums[:, :, 1:] // np.maximum(n, 1), books.astype(np.int64)).astype(np.float64)  # // goes down
    step = np.sqrt(((new - books) ** 2).sum(2))
    most, at = step.max(1), step.argmax(1)
    rest = step.copy()
    rest[np.arange(len(step)), at] = 0
    others = np.repeat(most[:, None], step.shape[1], 1)
    others[np.arange(len(step)), at] = rest.max(1)
    return new, drift + step + others


def compress(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, block_rows: int = 8192,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """Codes (vec_id, label, code, error) of all usable vectors, and the codebooks (parts x entries x length of a part).

    ``entries`` is 256 at most (two hex digits a part).
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark: SparkSession = vectors.sparkSession
    ship(spark)
    ws = Workspace(spark, "codes")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    kind = src.schema["label"].dataType.simpleString()
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    common = src.where(usable & (F.size("v") > 0)).groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    nothing = spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long")
    if common is None or common["size"] % parts:
        return nothing, np.zeros((parts, 0, 0))
    # vectors as whole numbers, and blocks of them
    whole = src.mapInArrow(_whole(scale, common["size"]), f"vec_id long, label {kind}, x binary")
    seeds = src.where(usable & (F.size("v") == common["size"])).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    first = np.clip(np.floor(np.array([r["v"] for r in seeds]) * scale), -_MOST, _MOST)
    books = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    drift = np.zeros(books.shape[:2])
    schema = _STATE.format(kind)
    state = ws.write(whole.mapInArrow(_blocks(block_rows), schema), "state0")
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((books, drift))
        after = ws.write(state.where("kind = 'block'").mapInArrow(_round(sent, parts, False), schema), f"state{k + 1}")
        ws.drop(f"state{k}")
        sums = after.where("kind = 'sums'").select("sums")
        for n in (None, 16, 1):  # a row a task, then by way of a few tasks
            sums = (sums.repartition(n) if n else sums).mapInArrow(_add_up, "sums binary")
        sums = sums.first()
        books, drift = _moved(books, np.frombuffer(sums["sums"], np.int64).reshape(*books.shape[:2], -1), drift)
        state = after
    sent = spark.sparkContext.broadcast((books, drift))
    out = state.where("kind = 'block'").mapInArrow(_round(sent, parts, True), f"vec_id long, label {kind}, code string, error long")
    out = ws.write(out, "coded")
    ws.drop(f"state{rounds}")
    return out, books


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector (whole numbers) that a code stands for."""
    return np.concatenate([books[p][int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))])


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: errors summed over equal labels, those without label together; sums come first, so a label of any size is one row of the join."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"), label_col="label")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, i, v[i * len(v) // 4 + 1 : (i + 1) * len(v) // 4] AS x FROM k, range(4) r(i))",
        "e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 256)",
        "b0 AS MATERIALIZED (SELECT i, e, x AS c FROM p JOIN e USING (vec_id))",
    ]
    for r in range(5):
        d = "CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT)"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, i, x, min((({d}) * 256 + e)) AS best FROM p JOIN b{r} USING (i) GROUP BY vec_id, i, x)")
        if r < 4:
            steps.append(f"m{r} AS (SELECT i, best % 256 AS e, j, floor(sum(x[j]) / count(*)) AS c FROM a{r}, range(1, 4097) t(j) WHERE j <= len(x) GROUP BY ALL)")
            steps.append(f"n{r} AS (SELECT i, e, list(c ORDER BY j) AS c FROM m{r} GROUP BY i, e)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT i, e, coalesce(n{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN n{r} USING (i, e))")
    steps += [
        "f AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY i) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id)",
        "s AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), 'string_agg', ','), ',' ORDER BY i, e)) AS codebooks_sha256 FROM b4)",
    ]
    return f"WITH {', '.join(steps)} SELECT f.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN k USING (vec_id), s"


OP12_SQL = _sql()
