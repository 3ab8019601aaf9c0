"""Photo features of small pixel grids: array<int> of RGBA values, row by row.

Grids come in batches of rows; numpy looks at all pixels of a slice of them at once. Values that a grid lacks are 0 (black) for
the stock photo rule, and unknown, which is never darker, for the hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gleaner.plans.shared import ship

_ROWS = 256  # grids looked at together


def _pixels(data: pa.ListArray, rows: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` values of each of the rows; doubles with NaN where one is missing."""
    offsets = data.offsets.to_numpy()
    starts, n = offsets[rows], pc.fill_null(pc.list_value_length(data), 0).to_numpy(zero_copy_only=False)[rows]
    first, end = int(starts.min()), int(offsets[rows + 1].max())
    values = data.values.slice(first, end - first)
    if not values.null_count and (n == size).all() and end - first == size * len(rows):
        return values.to_numpy().reshape(-1, size)
    values, starts, place = pc.cast(values, pa.float64()).to_numpy(zero_copy_only=False), starts - first, np.arange(size)
    out = np.full((len(rows), size), np.nan)
    known = place < n[:, None]
    out[known] = values[(starts[:, None] + place)[known]]
    return out


def _dhash(data: pa.ListArray, width: int, height: int) -> pa.Array:
    out = []
    for at in range(0, len(data), _ROWS):
        g = _pixels(data, np.arange(at, min(at + _ROWS, len(data))), width * height * 4).reshape(-1, height, width, 4)
        luma = 0.299 * g[..., 0] + 0.587 * g[..., 1] + 0.114 * g[..., 2]
        bits = (luma[:, :, :-1] < luma[:, :, 1:]).reshape(len(g), -1)
        short = -bits.shape[1] % 8  # zeros in front
        packed = np.packbits(np.pad(bits, ((0, 0), (short, 0))), axis=1)
        out += [row.tobytes().hex()[-(bits.shape[1] // 4) :] for row in packed]
    return pa.array(out, pa.string())


def _catalog_style(data: pa.ListArray, width: pa.Array, height: pa.Array) -> pa.Array:
    out = np.zeros(len(data), bool)
    known = pc.and_(pc.is_valid(width), pc.is_valid(height)).to_numpy(zero_copy_only=False)
    sizes = np.stack([pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (width, height)], axis=1)
    for w, h in np.unique(sizes, axis=0):
        if w < 8 or h < 8:
            continue
        ring = max(1, int(min(w, h) * 0.12))
        edge = np.ones((h, w), bool)
        edge[ring : h - ring, ring : w - ring] = False
        rows = np.flatnonzero((sizes == (w, h)).all(axis=1))
        for at in range(0, len(rows), _ROWS):
            some = rows[at : at + _ROWS]
            g = np.nan_to_num(_pixels(data, some, w * h * 4)).reshape(-1, h, w, 4)[..., :3]
            r, g, b = (np.ascontiguousarray(g[..., k]) for k in range(3))
            least = np.minimum(np.minimum(r, g), b)
            white = (least >= 243) & (np.maximum(np.maximum(r, g), b) - least <= 12)
            ring_white, subject = np.count_nonzero(white & edge, axis=(1, 2)), np.count_nonzero(~(white | edge), axis=(1, 2))
            out[some] = (ring_white / max(1, edge.sum()) >= 0.92) & (subject / max(1, (~edge).sum()) >= 0.08)
    # of a size that is unknown nothing can be said, but that it is too small
    small = pc.or_kleene(pc.less(width, 8), pc.less(height, 8))
    return pc.if_else(pa.array(known), pa.array(out), pc.if_else(pc.fill_null(small, False), False, pa.scalar(None, pa.bool_())))


def dhash(data: Column, width: int = 9, height: int = 8) -> Column:
    """64 bits in hex: whether each pixel is darker than its right neighbour."""
    ship(SparkSession.active())

    @F.arrow_udf("string")
    def of(g: pa.Array) -> pa.Array:
        return _dhash(g, width, height)

    return of(data)


def catalog_style(data: Column, width: Column, height: Column) -> Column:
    """A subject on pure white: a white ring around, and enough that is not white inside."""
    ship(SparkSession.active())

    @F.arrow_udf("boolean")
    def of(g: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        return _catalog_style(g, w, h)

    return of(data, width.cast("int"), height.cast("int"))
