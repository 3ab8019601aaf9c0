"""Shared plumbing: shipping the package, shared-folder tables, sizing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR = None


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor (once per Spark context)."""
    sc = spark.sparkContext
    if getattr(sc, "_gleaner_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = os.path.join(tempfile.mkdtemp(prefix="gleaner-"), "gleaner_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(os.path.join(top, "gleaner")):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(base, n)
                    z.write(p, os.path.relpath(p, top))
    sc.addPyFile(out)
    sc._gleaner_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; an own one only in local mode, where none is named."""
    global _OWN_DIR
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="gleaner-shared-")
    return "file://" + _OWN_DIR


class Workspace:
    """Tables that one operator call writes to the shared folder, so that lineage is cut and a lost
    executor costs a re-read. ``drop`` removes a table that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def again(self, df: DataFrame, name: str) -> DataFrame:
        """A written table once more, apart from ``df`` (joins of a table with itself)."""
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}")
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chars(df: DataFrame, col: str = "text") -> int:
    """Code points of all texts; sizes buckets before anything is shuffled."""
    return int(df.select(F.coalesce(F.sum(F.length(col)), F.lit(0)).alias("n")).first()["n"])


def buckets_for(entries: float, per_bucket: int = 4_000_000, least: int = 64) -> int:
    """Buckets such that a uniformly hashed one holds about ``per_bucket`` entries."""
    return int(max(least, -(-entries // per_bucket)))


def chunked(batches: Iterable, rows: int) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
