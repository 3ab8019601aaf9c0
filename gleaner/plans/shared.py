"""What driver and executors share: this package and a folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own = None


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; an own temporary folder only where that is unset (tests)."""
    global _own
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    _own = _own or "file://" + tempfile.mkdtemp(prefix="gleaner-shared-")
    return _own


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and what follows is planned without what it took."""
    path = f"{shared_dir(df.sparkSession)}/gleaner-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


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
