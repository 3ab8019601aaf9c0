"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (positives) and unlabelled texts, a mixture of both kinds. The
risk of a classifier g under class prior p is  p*R_P(g,+1) + max(0, R_U(g,-1) - p*R_P(g,-1)):  the
unlabelled risk as "clean", corrected by the share of positives in it, and kept from going negative.
The classifier is linear over the presence of hashed words and word beginnings, trained with numpy on the
driver; features are those that occur in enough positives and lean to one side the most.

Bounds: at most ``max_positive`` and ``max_unlabelled`` texts train (lowest hashes of their ids, so
the choice does not depend on partitions); features are counted and chosen in Spark, and of each text only its places among
the at most ``max_features`` chosen reach the driver. What is broadcast is the model, at most ``max_features`` weights. Every whole text is scored.

Defined cases: null and empty texts have no features and get the score of the bias alone; without
positives every score is 0; extra columns are ignored by ``score`` and kept by ``drop_toxic``; rows
that repeat a doc_id get equal scores for equal texts; labels of null are no labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.common import Workspace, chunked, ship, table

THRESHOLD = 0.7
_TRIM = b"0123456789.,;:!?\"'()[]{}<>|*#$%&@/\\+=-_~`"
_CLEAN = bytes(32 if b in _TRIM else b for b in range(256))


def _features(texts: list[str | None], starts_of: tuple[int, ...] = (5, 7)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words and word beginnings (first bytes) of each text, and their number per text."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_CLEAN) if t else b"" for t in texts]
    per, doc = [], []
    for lo, hi, part in W.pieces(raw):
        h, starts, ends = W.hash_piece(part.translate(W.LOWER))
        b = np.frombuffer(part.translate(W.LOWER), np.uint8)
        bounds = np.cumsum([len(r) + 1 for r in raw[lo:hi]]) if hi > lo + 1 else np.array([len(part)])
        d = np.searchsorted(bounds, starts, side="right") + lo
        per.append(h)
        doc.append(d)
        for k in starts_of:
            long = ends - starts > k
            per.append(W.hash_spans(b, starts[long], starts[long] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
            doc.append(d[long])
    if not per:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    f, d = np.concatenate(per), np.concatenate(doc)
    order = np.lexsort((f, d))
    f, d = f[order], d[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
    return f[new], np.bincount(d[new], minlength=len(texts))


def _count(batches):
    """Of each feature: the positives and the unlabelled texts of a batch that have it."""
    for b in chunked(batches, 512):
        f, n = _features(b.column("text").to_pylist())
        y = np.repeat(b.column("y").to_numpy(), n)
        v, inverse = np.unique(f, return_inverse=True)
        p = np.bincount(inverse, y, len(v)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(p), pa.array(np.bincount(inverse, minlength=len(v)) - p)], names=["f", "c_p", "c_u"])


def _rows_of(feats):
    def run(batches):
        """Of each text: the places of its features among the chosen ones."""
        for b in chunked(batches, 512):
            f, n = _features(b.column("text").to_pylist())
            doc, j = _places(f, n, feats.value)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.ListArray.from_arrays(pa.array(at), pa.array(j.astype(np.int32)))], names=["y", "j"])

    return run


def _places(f: np.ndarray, n: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and places of the features that are among ``feats`` (sorted)."""
    doc = np.repeat(np.arange(len(n)), n)
    if not len(feats):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    j = np.minimum(np.searchsorted(feats, f), len(feats) - 1)
    hit = feats[j] == f
    return doc[hit], j[hit]


def lean(c_p, c_u, n_p: int, n_u: int, prior: float):
    """Standard score (a Column) of the difference between a feature's share of the positives and of the clean texts."""
    share_p = c_p / n_p
    # share among the clean part of the unlabelled texts, from the mixture
    clean = F.greatest(c_u / n_u - prior * share_p, F.lit(0.0)) / (1 - prior)
    mean = (c_p + c_u + 1) / (n_p + n_u + 2)  # half a text added to each side
    return (share_p - clean) / F.sqrt(mean * (1 - F.least(mean, F.lit(0.999))) * (1 / n_p + 1 / n_u))


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float, epochs: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias, from each text's places among the features."""
    n_p, n_u = len(positives), len(unlabelled)

    def rows(docs):
        return np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs), len(docs)

    P, U = rows(positives), rows(unlabelled)
    w, bias = np.zeros(n_features), np.log(prior / (1 - prior))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)

    def margin(X):
        return np.bincount(X[0], w[X[1]], X[2]) + bias

    def grad(X, g):
        return np.append(np.bincount(X[1], g[X[0]], n_features), g.sum())

    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, epochs + 1):
        s_p, s_u = sigmoid(margin(P)), sigmoid(margin(U))
        # logistic loss: l(g,+1) has slope s-1, l(g,-1) has slope s
        risk_n = -np.log(1 - s_u + 1e-12).mean() + prior * np.log(1 - s_p + 1e-12).mean()
        neg = grad(U, s_u / n_u) - grad(P, prior * s_p / n_p)
        g = grad(P, prior * (s_p - 1) / n_p) + neg if risk_n >= 0 else -neg
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, float(bias)


def _scores(texts: list[str | None], model) -> np.ndarray:
    feats, w, bias = model
    f, n = _features(texts)
    doc, j = _places(f, n, feats)
    return 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[j], len(texts)) + bias, -500, 500)))


def _score(model):
    def run(batches):
        for b in chunked(batches, 512):
            yield b.drop_columns(["text"]).append_column("score", pa.array(_scores(b.column("text").to_pylist(), model.value), pa.float64()))

    return run


def _clean(model, text_col: str):
    def run(batches):
        for b in chunked(batches, 512):
            yield b.filter(pa.array(_scores(b.column(text_col).to_pylist(), model.value) < THRESHOLD))

    return run


def train(docs: DataFrame, positives: DataFrame, prior: float, max_positive: int, max_unlabelled: int, max_features: int = 512, min_lean: float = 5.0):
    """The model from ``docs`` (doc_id, text) and ``positives`` (distinct doc_id of confirmed toxic texts): sorted feature hashes, weights, bias."""
    none = np.zeros(0, np.uint64), np.zeros(0), -500.0
    pos = positives.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    total = docs.count()
    share = min(1.0, 1.2 * max_unlabelled / max(total, 1))
    # the lowest hashes: a filter thins the rows first, so only the sample is sorted
    low = docs.where(F.xxhash64("doc_id", F.lit(3)) <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64))))
    ids = low.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_unlabelled)
    marks = pos.select("doc_id", F.lit(1).alias("y")).unionByName(ids.select("doc_id", F.lit(0).alias("y")))
    # at most max_positive + max_unlabelled ids: a proven bound, so they are broadcast
    # of rows that repeat an id one trains, so the sample is bounded too
    found = docs.join(F.broadcast(marks), "doc_id").groupBy("y", "doc_id").agg(F.min("text").alias("text")).select("y", "text")
    found = Workspace(docs.sparkSession, "toxic").write(found, "sample")
    n = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return none
    counts = found.mapInArrow(_count, "f long, c_p long, c_u long").groupBy("f").agg(F.sum("c_p").alias("c_p"), F.sum("c_u").alias("c_u")).where("c_p >= 3")
    leans = counts.withColumn("lean", F.abs(lean(F.col("c_p"), F.col("c_u"), n[1], n[0], prior))).where(F.col("lean") >= min_lean)
    feats = np.sort(np.array([r["f"] for r in leans.orderBy(F.desc("lean"), "f").limit(max_features).collect()], np.int64).view(np.uint64))
    sides: dict[int, list[np.ndarray]] = {0: [], 1: []}
    # at most ``max_features`` numbers a text reach the driver
    for r in found.mapInArrow(_rows_of(docs.sparkSession.sparkContext.broadcast(feats)), "y int, j array<int>").orderBy("y", "j").toLocalIterator():
        sides[r["y"]].append(np.array(r["j"], np.int64))
    return feats, *fit(sides[1], sides[0], len(feats), prior)


def model_of(src: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 12_000):
    """A broadcast model. Only labels of 1 are used as such; the class prior is the share of 1 among the labels."""
    ship(src.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null")
    n, n_pos = known.select(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    prior = min(max(n_pos / n, 1e-4), 0.5) if n else 1e-4
    return src.sparkSession.sparkContext.broadcast(train(src, known.where("toxic = 1").select("doc_id").distinct(), prior, max_positive, max_unlabelled))


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 3000, max_unlabelled: int = 12_000,
) -> DataFrame:
    """doc_id and score of every row; ``labels`` (doc_id, toxic) are the rows to learn from."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_score(model_of(src, labels, max_positive, max_unlabelled)), "doc_id long, score double")


def held_out(id_col: str = "doc_id", modulus: int = 3, rest: int = 1):
    return F.crc32(F.col(id_col).cast("string")) % modulus == rest


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from labels that are not held out."""
    scored = score(docs, labels.where(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier takes for toxic: scored and filtered where they are read, each by its own text."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_clean(model_of(src, labels.where(~held_out())), text_col), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
