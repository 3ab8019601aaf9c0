"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Workspace


def components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(v, c) for every vertex of ``edges`` (a, b): c is the smallest vertex that it reaches.

    Each round hangs every larger neighbour of a vertex on its smallest neighbour, then every vertex
    with its smaller neighbours on the smallest of them (large-star, small-star); the number of
    rounds grows with the logarithm of the longest chain. Rounds are written to the shared folder; they end when
    the edges, held against two sums of 64-bit hashes, stay the same.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = ws.write(e, f"{name}-0")
    print_of = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
    was = print_of(e)
    k = 0
    while was[0]:
        k += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = ws.write(small.distinct(), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        now = print_of(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(e.select("v", F.col("v").alias("c")).distinct())
