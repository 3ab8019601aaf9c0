"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are covered, whole, by overlapping chunks. In each chunk learned filters slide over
embedded bytes; each filter keeps its largest response (max-pooling), a small hidden layer turns these
into one logit a chunk, and the chunks' logits, weighted by the bytes they hold, average to the
document's logit and so to one probability. Training back-propagates through all of this.

Bounds: at most ``max_docs`` labelled texts train, lowest id hashes first and as many of each label as
there are, of at most ``max_bytes`` altogether and a 32nd of that each (texts stay whole; others are left
out of training; texts are taken in the order of hashes). The
broadcast model has some 6,000 numbers. Every whole text is scored, chunk by chunk, in bounded memory.

Defined cases: null and empty texts have one chunk of padding and so get one fixed score; without labels
of both kinds every score is the share of label 1 (1 without any label); labels of null are no labels;
extra columns are ignored; rows that repeat a doc_id are scored each on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import chunked, ship, table

THRESHOLD = 0.3
CHUNK, HOP, WIDTH, STRIDE = 384, 320, 12, 3
EMBED, FILTERS, HIDDEN = 8, 32, 16
_POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
_PAD = 256


def chunk_bytes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks (rows of byte values, padded), the text of each, and how many bytes it holds."""
    lens = np.array([len(r) for r in raws], np.int64)
    n = np.maximum(1, -(-(lens - (CHUNK - HOP)) // HOP))
    doc = np.repeat(np.arange(len(raws)), n)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * HOP
    held = np.minimum(CHUNK, lens[doc] - at)
    flat = np.frombuffer(b"".join(raws) + bytes(CHUNK), np.uint8)
    idx = (at + (np.cumsum(lens) - lens)[doc])[:, None] + np.arange(CHUNK)
    x = flat[np.minimum(idx, len(flat) - 1)].astype(np.int16)
    x[np.arange(CHUNK) >= held[:, None]] = _PAD
    return x, doc, np.maximum(held, 1)


def start(seed: int = 5) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    return {
        "E": np.vstack([g.normal(0, 0.5, (256, EMBED)), np.zeros((1, EMBED))]).astype(np.float32),
        "C": g.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "c": np.zeros(FILTERS, np.float32),
        "H": g.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)).astype(np.float32),
        "h": np.zeros(HIDDEN, np.float32),
        "o": g.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
        "b": np.zeros(1, np.float32),
    }


def _pool(m: dict, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, each filter's largest response in each chunk, and where it is."""
    e = m["E"][x]
    s = e.strides
    shape = (len(x), _POSITIONS, WIDTH, EMBED)
    win = np.lib.stride_tricks.as_strided(e, shape, (s[0], s[1] * STRIDE, s[1], s[2])).reshape(len(x), _POSITIONS, -1)
    r = win @ m["C"]
    # windows that start in the padding do not count, but for the first
    r[np.arange(_POSITIONS) * STRIDE >= held[:, None]] = -1e9
    arg = r.argmax(axis=1)
    return win, np.take_along_axis(r, arg[:, None], 1)[:, 0] + m["c"], arg


def _logits(m: dict, x: np.ndarray, held: np.ndarray) -> np.ndarray:
    _, p, _ = _pool(m, x, held)
    return np.maximum(np.maximum(p, 0) @ m["H"] + m["h"], 0) @ m["o"] + m["b"][0]


def predict(m: dict, raws: list[bytes], step: int = 96) -> np.ndarray:
    """Probabilities of whole texts."""
    x, doc, held = chunk_bytes(raws)
    z = np.concatenate([_logits(m, x[i : i + step], held[i : i + step]) for i in range(0, len(x), step)]) if len(x) else np.zeros(0)
    n = len(raws)
    g = np.bincount(doc, z * held, n) / np.maximum(np.bincount(doc, held, n), 1)
    return 1 / (1 + np.exp(-np.clip(g, -60, 60)))


def _slopes(m: dict, x: np.ndarray, doc: np.ndarray, held: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted logistic loss over the texts of one batch."""
    n = len(y)
    win, p, arg = _pool(m, x, held)
    a = np.maximum(p, 0)
    q = a @ m["H"] + m["h"]
    b = np.maximum(q, 0)
    z = b @ m["o"] + m["b"][0]
    share = held / np.bincount(doc, held, n)[doc]
    s = 1 / (1 + np.exp(-np.clip(np.bincount(doc, z * share, n), -60, 60)))
    dz = (((s - y) * w)[doc] * share).astype(np.float32)
    dq = dz[:, None] * m["o"] * (q > 0)
    dp = (dq @ m["H"].T) * (p > 0)
    top = np.take_along_axis(win, arg[:, :, None], 1)  # the window that each filter chose
    dtop = dp[:, :, None] * m["C"].T[None]
    at = arg[:, :, None] * STRIDE + np.arange(WIDTH)
    used = np.take_along_axis(x[:, None, :], at, 2).ravel()
    de = dtop.reshape(-1, EMBED)
    dE = np.stack([np.bincount(used, de[:, k], 257) for k in range(EMBED)], axis=1).astype(np.float32)
    dE[_PAD] = 0
    return {
        "E": dE, "C": np.einsum("cfk,cf->kf", top, dp), "c": dp.sum(0), "H": a.T @ dq, "h": dq.sum(0), "o": b.T @ dz, "b": dz.sum(keepdims=True)
    }


def fit(raws: list[bytes], y: np.ndarray, epochs: int = 12, batch: int = 16, rate: float = 4e-3, seed: int = 5) -> dict[str, np.ndarray]:
    m, g = start(seed), np.random.default_rng(seed)
    mean, var = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    w = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    t, steps = 0, epochs * -(-len(raws) // batch)
    for _ in range(epochs):
        order = g.permutation(len(raws))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            x, doc, held = chunk_bytes([raws[i] for i in own])
            t += 1
            lr = rate * (1 - t / (steps + 1))
            for k, d in _slopes(m, x, doc, held, y[own], w[own] / len(own)).items():
                mean[k] = 0.9 * mean[k] + 0.1 * d
                var[k] = 0.999 * var[k] + 0.001 * d * d
                m[k] = (m[k] - lr * (mean[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return m


def _raw(t: str | None) -> bytes:
    return t.encode("utf-8", "surrogatepass") if t else b""


def _score(sent):
    def run(batches):
        for b in chunked(batches, 256):
            raws = [_raw(t) for t in b.column("text").to_pylist()]
            s = np.zeros(len(raws))
            lo = 0
            while lo < len(raws):  # some 2 MB of text at a time; a longer text alone, in parts of the same size
                hi, size = lo + 1, len(raws[lo])
                while hi < len(raws) and size + len(raws[hi]) < 2 << 20:
                    size += len(raws[hi])
                    hi += 1
                s[lo:hi] = predict(sent.value, raws[lo:hi]) if size < 8 << 20 else _long(sent.value, raws[lo])
                lo = hi
            yield b.drop_columns(["text"]).append_column("score", pa.array(s, pa.float64()))

    return run


def _long(m: dict, raw: bytes, part: int = HOP * 4096) -> float:
    """The probability of one very long text, computed part by part."""
    total, weight = 0.0, 0
    for at in range(0, max(1, len(raw) - (CHUNK - HOP)), part):
        x, _, held = chunk_bytes([raw[at : at + part + CHUNK - HOP]])
        for i in range(0, len(x), 96):
            total += float((_logits(m, x[i : i + 96], held[i : i + 96]) * held[i : i + 96]).sum())
        weight += int(held.sum())
    return 1 / (1 + np.exp(-np.clip(total / weight, -60, 60)))


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 1200, max_bytes: int = 8 << 20,
) -> DataFrame:
    """doc_id and score of every row; ``labels`` (doc_id, quality) are the rows to learn from."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = None
    for v in (0, 1):
        part = known.where(F.col("y") == v).orderBy(*order).limit(max_docs // 2)
        picked = part if picked is None else picked.unionByName(part)
    # at most max_docs ids: a proven bound, so they are broadcast
    found = src.join(F.broadcast(picked), "doc_id").where(F.length("text") <= max_bytes // 32)
    rows, size = [], 0
    # in the order of hashes, so that neither files nor partitions decide who trains
    for r in found.orderBy(*order, "text").limit(2 * max_docs).toLocalIterator():
        raw = _raw(r["text"])
        size += len(raw)
        if size > max_bytes:
            break
        rows.append((raw, r["y"]))
    y = np.array([r[1] for r in rows], float)
    if len(rows) and 0 < y.mean() < 1:
        sent = spark.sparkContext.broadcast(fit([r[0] for r in rows], y))
        return src.mapInArrow(_score(sent), "doc_id long, score double")
    return src.select("doc_id", F.lit(float(y.mean()) if len(y) else 1.0).alias("score"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from labels that are not held out."""
    scored = score(docs, labels.where(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
