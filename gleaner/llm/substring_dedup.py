"""Substring deduplication with difference-cover anchors.

A window of ``WINDOW`` consecutive words is removed where the same words start earlier (smaller id, or
earlier in the same document); every word that a removed window covers goes.

Hashing and shuffling every window would cost more than the texts. Instead, short anchors are hashed
only at word positions that fall, modulo ``PERIOD``, on a difference cover: for any two positions p and
q some shift k < PERIOD puts both p+k and q+k on the cover. So two equal windows share at least one
aligned anchor inside them, and a window without a repeated anchor is unique. Three steps:

1. anchors go to buckets, which answer each unit with one bit an anchor: repeated or not;
2. repeated anchors extend to all windows that hold one; these are hashed in full (96 bits over 64-bit
   word hashes), and buckets answer, for each, whether an earlier window is equal;
3. each unit marks what its removed windows cover.

Every unit sends a hash at most once, so copies by the thousand make no hot bucket.

Defined cases: a null text has no words; texts shorter than a window are never touched; empty tables
give empty results; extra columns, whatever their names, are kept by ``dedup_substrings``; rows that
repeat an id count as documents of their own, the one read first being the earlier; a null id is
smaller than all others.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import units as U
from gleaner.llm import words as W
from gleaner.llm.common import Workspace, buckets_for, ship, table

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)  # differences of these give every residue modulo 13
ANCHOR = WINDOW - PERIOD + 1
_NULL_ID = -(2**63)


class _Unit:
    """Word hashes, places and windows of one unit; the same wherever it is computed."""

    def __init__(self, payload: bytes, id_col: str, text_col: str):
        self.table = U.open_unit(payload)
        self.raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in self.table.column(text_col).to_pylist()]
        self.ids = np.array([_NULL_ID if i is None else i for i in self.table.column(id_col).to_pylist()], np.int64)
        self.words, self.counts = W.hash_texts(self.raw)
        self.starts = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.pos = np.arange(len(self.words)) - self.starts[self.doc]
        self.left = self.counts[self.doc] - self.pos  # words from here to the document's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Word places of the anchors and their hashes."""
        on = np.zeros(PERIOD, bool)
        on[list(COVER)] = True
        ok = on[self.pos % PERIOD] & (self.left >= ANCHOR) & (self.counts[self.doc] >= WINDOW)
        at = np.flatnonzero(ok)
        return at, W.window_hashes(self.words, ANCHOR)[at] if len(at) else np.zeros(0, np.uint64)

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of windows that hold a repeated anchor, and their two hashes."""
        n = len(self.words)
        flag = np.zeros(n + 1, np.int64)
        flag[repeated] = 1
        upto = np.concatenate([[0], np.cumsum(flag)])
        here = np.arange(n)
        at = np.flatnonzero((self.left >= WINDOW) & (upto[np.minimum(here + PERIOD, n)] > upto[here]))
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return at, W.window_hashes(self.words, WINDOW)[at], W.window_hashes(self.words, WINDOW, 1)[at] & np.uint64(0xFFFFFFFF)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(h, return_index=True, return_inverse=True, return_counts=True)


def _send_anchors(buckets: int, id_col: str, text_col: str):
    def run(batches):
        for b in batches:
            for unit, payload in zip(b.column("unit").to_pylist(), b.column("payload").to_pylist()):
                _, h = _Unit(payload, id_col, text_col).anchors()
                v, _, _, n = _distinct(h)
                order, present, at = U.by_bucket(v, buckets)
                v, n = v[order], n[order]
                runs = [(v[i:j] >> np.uint64(24), n[i:j] > 1) for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(present), pa.array([unit] * len(present), pa.int64()), pa.array([U.planes(x, 5) for x, _ in runs], pa.binary()), pa.array([U.bits(m) for _, m in runs], pa.binary())],
                    names=["bucket", "unit", "h", "multi"],
                )

    return run


def _answer_anchors(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """One bit an anchor: it occurs twice or more (five hash bytes in a bucket: rarely one too many)."""
    runs = [U.unplanes(x, 5) for x in t.column("h").to_pylist()]
    sizes = [len(r) for r in runs]
    multi = np.concatenate([U.unbits(x, n) for x, n in zip(t.column("multi").to_pylist(), sizes)])
    v = np.concatenate(runs)
    order = np.argsort(v, kind="stable")
    s = v[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(v), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    # an anchor that one unit holds twice is repeated for all who hold it
    out = twice | multi
    parts = np.split(out, np.cumsum(sizes)[:-1])
    return pa.table({"unit": t.column("unit"), "bucket": t.column("bucket"), "kind": pa.array([0] * len(parts), pa.int32()), "mask": pa.array([U.bits(p) for p in parts], pa.binary())})


def _masks(masks: pa.Table, kind: int) -> dict[int, bytes]:
    rows = zip(masks.column("bucket").to_pylist(), masks.column("kind").to_pylist(), masks.column("mask").to_pylist())
    return {b: m for b, k, m in rows if k == kind}


def _marked(h: np.ndarray, masks: dict[int, bytes], buckets: int) -> np.ndarray:
    """Of distinct hashes: whether their bucket's answer marks them."""
    order, present, at = U.by_bucket(h, buckets)
    out = np.zeros(len(h), bool)
    for b, i, j in zip(present.tolist(), at[:-1], at[1:]):
        if b in masks:
            out[order[i:j]] = U.unbits(masks[b], j - i)
    return out


def _windows(u: _Unit, masks: pa.Table, buckets: int):
    """Candidate windows of a unit: places, and of the distinct ones first place, inverse, both hashes."""
    at, h = u.anchors()
    v, _, inverse, _ = _distinct(h)
    at, h1, h2 = u.candidates(at[_marked(v, _masks(masks, 0), buckets)[inverse]])
    # both hashes tell windows apart: a structured sort would be slow, so fold the second into the first
    v, first, inverse, _ = _distinct(h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15)))
    return at, v, first, inverse, h2


def _send_windows(buckets: int, buckets2: int, id_col: str, text_col: str):
    def run(key: tuple[pa.Scalar, ...], own: pa.Table, masks: pa.Table) -> pa.Table:
        names = ["bucket", "unit", "h", "h2", "id"]
        if not own.num_rows or not masks.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "unit": pa.array([], pa.int64()), **{n: pa.array([], pa.binary()) for n in names[2:]}})
        u = _Unit(own.column("payload")[0].as_py(), id_col, text_col)
        at, v, first, _, h2 = _windows(u, masks, buckets)
        order, present, cut = U.by_bucket(v, buckets2)
        v, h2, ids = v[order], h2[first][order], u.ids[u.doc[at[first]]][order]
        spans = list(zip(cut[:-1], cut[1:]))
        return pa.table({
            "bucket": pa.array(present), "unit": pa.array([key[0].as_py()] * len(present), pa.int64()),
            "h": pa.array([U.planes(v[i:j], 8) for i, j in spans], pa.binary()), "h2": pa.array([U.planes(h2[i:j], 4) for i, j in spans], pa.binary()),
            "id": pa.array([U.planes(ids[i:j].view(np.uint64), 8) for i, j in spans], pa.binary()),
        })

    return run


def _answer_windows(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """One bit a window: an equal window of another unit starts earlier."""
    v = [U.unplanes(x, 8) for x in t.column("h").to_pylist()]
    sizes = [len(x) for x in v]
    v, h2 = np.concatenate(v), np.concatenate([U.unplanes(x, 4) for x in t.column("h2").to_pylist()])
    ids = np.concatenate([U.unplanes(x, 8).view(np.int64) for x in t.column("id").to_pylist()])
    unit = np.repeat(np.array(t.column("unit").to_pylist(), np.int64), sizes)
    order = np.lexsort((unit, ids, h2, v))
    v, h2 = v[order], h2[order]
    later = np.zeros(len(v), bool)
    later[order[1:]] = (v[1:] == v[:-1]) & (h2[1:] == h2[:-1])
    parts = np.split(later, np.cumsum(sizes)[:-1])
    return pa.table({"unit": t.column("unit"), "bucket": t.column("bucket"), "kind": pa.array([1] * len(parts), pa.int32()), "mask": pa.array([U.bits(p) for p in parts], pa.binary())})


def _without(raw: bytes, drop: np.ndarray) -> bytes:
    """A text without its dropped words and the white space after each; all other white space stays."""
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    out, at = [], 0
    for k in np.flatnonzero(drop).tolist():
        out.append(raw[at : spans[k][0]] if at < spans[k][0] else b"")
        at = spans[k + 1][0] if k + 1 < len(spans) else len(raw)
    return b"".join(out) + raw[at:]


def _finish(buckets: int, buckets2: int, id_col: str, text_col: str, schema: pa.Schema, with_rows: bool):
    def run(key: tuple[pa.Scalar, ...], own: pa.Table, masks: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        u = _Unit(own.column("payload")[0].as_py(), id_col, text_col)
        at, v, first, inverse, _ = _windows(u, masks, buckets)
        lost = _marked(v, _masks(masks, 1), buckets2)[inverse]
        own_first = np.zeros(len(at), bool)
        own_first[first] = True
        gone = at[lost | ~own_first]
        cover = np.zeros(len(u.words) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + WINDOW, -1)
        drop = np.cumsum(cover[:-1]) > 0 if len(u.words) else np.zeros(0, bool)
        removed = np.bincount(u.doc[drop], minlength=len(u.counts))
        if with_rows:
            old = u.table.column(text_col).to_pylist()
            text = [_without(r, drop[s : s + n]).decode("utf-8", "surrogatepass") if k else t for r, t, k, s, n in zip(u.raw, old, removed, u.starts, u.counts)]
            return u.table.set_column(u.table.schema.get_field_index(text_col), text_col, pa.array(text, pa.string())).cast(schema)
        kept = []
        for i, raw in enumerate(u.raw):
            w = raw.split()
            if removed[i]:
                w = np.array(w, object)[~drop[u.starts[i] : u.starts[i] + u.counts[i]]].tolist()
            kept.append(b" ".join(w))
        return pa.table({
            "doc_id": u.table.column(id_col), "n_words": pa.array(u.counts), "n_removed": pa.array(removed.astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
        }).cast(schema)

    return run


def _run(docs: DataFrame, id_col: str, text_col: str, with_rows: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "substr")
    src = docs.withColumn(id_col, F.col(id_col).cast("long")).withColumn(text_col, F.col(text_col).cast("string"))
    units = U.make_units(src, ws, id_col=id_col, text_col=text_col)
    chars = U.total_chars(units)
    buckets, buckets2 = buckets_for(chars / 6 * len(COVER) / PERIOD), buckets_for(chars / 6)
    sent = units.mapInArrow(_send_anchors(buckets, id_col, text_col), "bucket long, unit long, h binary, multi binary")
    masks = sent.groupBy("bucket").applyInArrow(_answer_anchors, "unit long, bucket long, kind int, mask binary")
    masks = ws.write(masks, "anchor_masks")
    body = units.select("unit", "payload")
    windows = body.groupBy("unit").cogroup(masks.groupBy("unit")).applyInArrow(
        _send_windows(buckets, buckets2, id_col, text_col), "bucket long, unit long, h binary, h2 binary, id binary"
    )
    masks2 = windows.groupBy("bucket").applyInArrow(_answer_windows, "unit long, bucket long, kind int, mask binary")
    both = masks.unionByName(ws.write(masks2, "window_masks"))
    if with_rows:
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in src.schema])
    else:
        schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string")
    finish = _finish(buckets, buckets2, id_col, text_col, to_arrow_schema(schema), with_rows)
    return body.groupBy("unit").cogroup(both.groupBy("unit")).applyInArrow(finish, schema)


def substring_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of every row."""
    return _run(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", False)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed words, and the white space after each of them, cut out of the texts; the rest stays as it was."""
    return _run(docs, id_col, text_col, True)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))
