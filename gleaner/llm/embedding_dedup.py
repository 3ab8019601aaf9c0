"""Embedding near-duplicates: an exact metric range join.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2-2c). Pivots cut the space into cells
(each vector's home is its nearest pivot). By the triangle inequality a vector x can have partners
at home in another cell only if it is near enough to the border between the two pivots: with p its own pivot and q the
other, x.(p-q) <= r*|p-q| (and never beyond d(x,q) <= d(x,p) + 2r). Of two cells one copies its border vectors to the other
(which of them alternates), so a pair meets in one cell only, and cells join independently of each other.

A cell is a number of blocks of bounded size, its own vectors' and its copies'; a task joins one block with another, so neither
a crowded cell nor a popular border grows a task. Pivots grow with the vectors, as far as ``most_bytes`` of them
can be broadcast; beyond that cells have more blocks.

Equal vectors are one class with a weight, so copies cost nothing; tiles put out a count and a
component label for each of their classes with links, never pairs. In many dimensions without structure nearly every
vector is near every border: the join is then close to all pairs in blocks, which is inherent to an
exact answer, and the rows sent grow with the square of the vectors over the size of a block.

Defined cases: vectors that are null, empty, zero, or hold nulls or non-finite numbers link with nothing;
vectors of different lengths link with nothing but vectors of their own length; rows that repeat an id are one
vertex, counted by rows; rows without id link with nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Workspace, chunked, ship, table
from gleaner.llm.graph import components

_CELLS = 1 << 21  # of a matrix of rows x pivots, or of rows x rows
_SLACK = 1e-6  # of bounds, above the rounding of double precision


def _normal(batches):
    """Usable vectors as unit vectors (doubles), with a digest of their exact values."""
    for b in batches:
        ids, unit, dims, marks = [], [], [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = None
            if v and None not in v:
                x = np.array(v, np.float64)
                most = np.abs(x).max()
                if np.isfinite(most) and most and not 1e-100 < most < 1e100:  # whose squares would over- or underflow
                    x = x / most
                size = np.sqrt(x @ x) if np.isfinite(x).all() else 0.0
                x = x / size if size > 0 and np.isfinite(size) else None
            ids.append(i)
            dims.append(len(v) if x is not None else 0)
            unit.append(x.tobytes() if x is not None else None)
            marks.append(hashlib.blake2b(np.array(v, np.float64).tobytes(), digest_size=16).digest() if x is not None else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(unit, pa.binary()), pa.array(marks, pa.binary())], names=["vec_id", "dim", "u", "mark"]
        )


def _home(pivots, radius: float):
    """Each vector's own cell, and the cells that it is copied to. Lengths without pivots are a cell each."""

    def run(batches):
        by_dim = pivots.value
        for b in chunked(batches, 2048):
            dims, raws = np.array(b.column("dim").to_pylist()), b.column("u").to_pylist()
            rows, cells, own = [], [], []
            # a few matrices of rows x pivots at a time, whatever the number of pivots
            parts = [(d, at) for d in np.unique(dims).tolist() for all_ in [np.flatnonzero(dims == d)] for n in [max(1, _CELLS // len(by_dim[d][1])) if d in by_dim else len(all_)] for at in np.split(all_, range(n, len(all_), n))]
            for dim, mine in parts:
                if dim not in by_dim:
                    rows.append(mine)
                    cells.append(np.full(len(mine), -dim))
                    own.append(np.ones(len(mine), bool))
                    continue
                x = np.frombuffer(b"".join(raws[r] for r in mine)).reshape(-1, dim)
                first, p = by_dim[dim]
                s, here = x @ p.T, np.arange(len(x))
                home = s.argmax(axis=1)
                gap = np.sqrt(np.maximum(2 - 2 * (p[home] @ p.T), 0))  # |p - q|
                near = s[here, home][:, None] - s <= radius * gap + _SLACK
                other = np.arange(len(p))
                near &= (home[:, None] < other) == ((home[:, None] + other) % 2 == 0)  # one way between two cells
                near[here, home] = True
                i, j = np.nonzero(near)
                rows.append(mine[i])
                cells.append(first + j)
                own.append(j == home[i])
            rows, cells, own = np.concatenate(rows), np.concatenate(cells), np.concatenate(own)
            yield b.take(pa.array(rows)).append_column("cell", pa.array(cells.astype(np.int64))).append_column("own", pa.array(own))

    return run


def _joined(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after the links a[k]-b[k] between components."""
    while len(a):
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            break
        up = np.arange(len(comp))
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        comp, a, b = up[comp], up[a], up[b]
    return comp


def _tile(cosine: float, bar: float):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts and labels of the classes of two blocks that have links between them; ``key`` ends with the two blocks."""
        none = pa.table({"v": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "label": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        same = key[1].as_py() == key[2].as_py()  # a block with itself: each pair is seen from both sides
        read = lambda t: np.frombuffer(b"".join(t.column("u").to_pylist())).reshape(t.num_rows, -1)
        x, y = read(left), read(right)
        vx, vy = left.column("v").to_numpy(), right.column("v").to_numpy()
        wx, wy = left.column("weight").to_numpy(), right.column("weight").to_numpy()
        n_x, n_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        # components of the classes of both blocks: of a block with itself they are the same classes
        shift = 0 if same else len(x)
        comp = np.arange(shift + len(y))
        on = np.zeros(shift + len(y), bool)
        x32, y32 = x.astype(np.float32), y.astype(np.float32)
        step = max(1, min(256, _CELLS // len(y)))
        for lo in range(0, len(x), step):
            s = x32[lo : lo + step] @ y32.T
            i, j = np.nonzero(s >= bar)
            if not len(i):
                continue
            tight = s[i, j] < cosine + (cosine - bar)
            if tight.any():  # single precision cannot tell: decide in double
                ok = np.ones(len(i), bool)
                at = np.flatnonzero(tight)
                for k in range(0, len(at), 1 << 16):
                    some = at[k : k + (1 << 16)]
                    ok[some] = np.einsum("ij,ij->i", x[lo + i[some]], y[j[some]]) >= cosine
                i, j = i[ok], j[ok]
            i = i + lo
            other = vx[i] != vy[j]
            i, j = i[other], j[other]
            n_x += np.bincount(i, wy[j], len(x)).astype(np.int64)
            if not same:
                n_y += np.bincount(j, wx[i], len(y)).astype(np.int64)
            on[i], on[shift + j] = True, True
            comp = _joined(comp, comp[i], comp[shift + j])  # at once: links are not kept
        if not on.any():
            return none
        v = vy if same else np.concatenate([vx, vy])
        least = np.full(len(comp), np.iinfo(np.int64).max)
        np.minimum.at(least, comp, v)
        label = least[comp]
        on_x, on_y = np.flatnonzero(on[: len(x)]), np.flatnonzero(on[shift:])
        label_x, label_y = label[: len(x)], label[shift:]
        parts = ((vx, n_x, label_x, on_x),) if same else ((vx, n_x, label_x, on_x), (vy, n_y, label_y, on_y))
        return pa.table({name: pa.array(np.concatenate([part[k][part[3]] for part in parts])) for k, name in enumerate(("v", "n", "label"))})

    return run


def near_vectors(
    table_: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = 8 << 20, most_bytes: int = 64 << 20,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; ``block_bytes`` of doubles make a block, and a cell is meant to have about one of its own."""
    spark: SparkSession = table_.sparkSession
    ship(spark)
    ws = Workspace(spark, "vectors")
    src = table_.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    units = ws.write(src.mapInArrow(_normal, "vec_id long, dim int, u binary, mark binary"), "units")
    live = units.where("dim > 0 and vec_id is not null")
    # equal vectors are a class, named by its smallest id and weighted by its rows
    classes = live.groupBy("dim", "mark").agg(F.min("vec_id").alias("v"), F.count(F.lit(1)).alias("weight"), F.first("u").alias("u"))
    classes = ws.write(classes, "classes")
    out = units.join(classes.select("dim", "mark", "v", "weight"), ["dim", "mark"], "left").select("vec_id", "v", "weight")
    # the commonest lengths get pivots; each rarer one is a cell of blocks
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(100).collect()}
    pivots, first, room = {}, 0, most_bytes
    for dim, n in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0])):
        k = min(round(n * 8 * dim / block_bytes), room // (8 * dim))
        if k > 1:
            rows = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("v"), "v").limit(k).select("u").collect()
            pivots[dim] = (first, np.stack([np.frombuffer(r["u"]) for r in rows]))
            first, room = first + k, room - 8 * dim * k
    radius = float(np.sqrt(2 - 2 * cosine))
    fields = "dim int, v long, weight long, u binary"
    placed = classes.select("dim", "v", "weight", "u").mapInArrow(_home(spark.sparkContext.broadcast(pivots), radius), f"{fields}, cell long, own boolean")
    placed = ws.write(placed, "placed")
    # blocks of a cell: first its own vectors' (m), then its copies' (c), dealt by hash
    per = F.lit(float(block_bytes)) / (8 * F.first("dim"))
    blocks = lambda of: F.ceil(F.count_if(of) / per).cast("int")
    crowd = placed.groupBy("cell").agg(blocks(F.col("own")).alias("m"), blocks(~F.col("own")).alias("c"))
    crowd = ws.write(crowd, "crowd")
    dealt = lambda n: F.pmod(F.xxhash64("v"), n).cast("int")
    block = F.when(F.col("own"), dealt(F.col("m"))).otherwise(F.col("m") + dealt(F.col("c")))
    held, again = (p.join(c, "cell").withColumn("block", block) for p, c in ((placed, crowd), (ws.again(placed, "placed"), ws.again(crowd, "crowd"))))
    # tiles (i, j): i an own block, j the same or a later one
    left = held.where("own").select("cell", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("m") + F.col("c") - 1)).alias("j"), "v", "weight", "u")
    upto = F.least(F.col("block"), F.col("m") - 1)
    right = again.where("m > 0").select("cell", F.explode(F.sequence(F.lit(0), upto)).alias("i"), F.col("block").alias("j"), "v", "weight", "u")
    keys = ("cell", "i", "j")
    joined = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(cosine, cosine - 1e-4), "v long, n long, label long")
    joined = ws.write(joined, "joined")
    ws.drop("placed")
    links = joined.groupBy("v").agg(F.sum("n").alias("n"))
    comp = components(joined.where("v <> label").select(F.col("v").alias("a"), F.col("label").alias("b")), ws)
    out = out.join(links, "v", "left").join(comp, "v", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "v", "vec_id"))
    n_links = F.when(F.col("v").isNull() | F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
