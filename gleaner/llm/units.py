"""Units: bounded runs of rows, each packed with all its columns into one compressed binary.

Rows meet in a unit by where they are read, sorted by id. A unit is the grain at which operators send
answers ("these of your hashes occur elsewhere") back to texts: what is shuffled is a bit a hash and
the compressed unit, never a row a word. Hashes travel to buckets as sorted, distinct, byte-planed
runs, one row a (unit, bucket), so a hash that a third of all texts share counts once a unit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Workspace



def _pack(id_col: str, text_col: str, size: int):
    def pack(batches: list[pa.RecordBatch], unit: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        t = t.take(pa.compute.sort_indices(t, [(id_col, "ascending")], null_placement="at_start"))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        chars = pa.compute.sum(pa.compute.utf8_length(t.column(text_col))).as_py() or 0
        return pa.RecordBatch.from_arrays(
            [pa.array([unit], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([t.num_rows]), pa.array([chars], pa.int64())],
            names=["unit", "payload", "n_rows", "n_chars"],
        )

    def run(batches):
        unit, held, bytes_ = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                n = 0
                lens = pa.compute.fill_null(pa.compute.binary_length(b.column(text_col).slice(at)), 0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(lens + 16)
                n = max(1, int(np.searchsorted(upto, size - bytes_, side="right")))
                held.append(b.slice(at, n))
                bytes_ += int(upto[min(n, len(upto)) - 1])
                at += n
                if bytes_ >= size or at < b.num_rows:
                    yield pack(held, unit)
                    unit, held, bytes_ = unit + 1, [], 0
        if held:
            yield pack(held, unit)

    return run


def make_units(docs: DataFrame, ws: Workspace, name: str = "units", id_col: str = "doc_id", text_col: str = "text", size: int = 4 << 20) -> DataFrame:
    """Writes ``docs`` as units of about ``size`` bytes of text: unit, payload, n_rows, n_chars."""
    return ws.write(docs.mapInArrow(_pack(id_col, text_col, size), "unit long, payload binary, n_rows long, n_chars long"), name)


def open_unit(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def planes(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, plane by plane."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    p = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, :width] = p.T
    return out.view("<u8").ravel()


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of distinct hashes by bucket and value; the buckets present; where each one's run begins."""
    b = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, b))
    present, at = np.unique(b[order], return_index=True)
    return order, present, np.append(at, len(order))


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def total_chars(units: DataFrame) -> int:
    return int(units.select(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0])
