"""Which listings come near a moving window, and when first: an interval join over bins, without pairs of windows and listings.

A window of height h at y looks ``LOOKAHEAD`` heights ahead and back. Of the bins that such a range covers whole, only the first window of each bin
matters: it sees all that the bin holds. Only at its two ends does a range meet listings that it may miss, and there just the first window of each distinct
end matters, of which a bin has at most as many as it has pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed as X

BIN = 1024


def _bin(y: Column) -> Column:
    return F.floor(y / F.lit(float(BIN))).cast("long")


def _bins(lo: Column, hi: Column) -> Column:
    return F.sequence(_bin(lo), _bin(hi))


def _seen(items: DataFrame, windows: DataFrame) -> DataFrame:
    """page_id, item_id and the first ``seq`` whose range [lo, hi] meets the item's [top, bottom]."""
    held = items.select("page_id", "item_id", "top", "bottom", F.explode(_bins(F.col("top"), F.col("bottom"))).alias("bin"))
    over = windows.select("page_id", "seq", "lo", "hi", F.explode(_bins(F.col("lo"), F.col("hi"))).alias("bin"))
    start, end = F.col("bin") * BIN, (F.col("bin") + 1) * BIN
    whole = (F.col("lo") <= start) & (F.col("hi") >= end)
    first = over.where(whole).groupBy("page_id", "bin").agg(F.min("seq").alias("seq"))
    # within a bin, a range that ends there is its end only
    ends = over.where(~whole).select("page_id", "bin", "seq", F.greatest("lo", start).alias("lo"), F.least("hi", end).alias("hi")).groupBy("page_id", "bin", "lo", "hi").agg(F.min("seq").alias("seq"))
    by_bin = held.join(first, ["page_id", "bin"]).select("page_id", "item_id", "seq")
    by_end = held.join(ends, ["page_id", "bin"]).where("top <= hi and bottom >= lo").select("page_id", "item_id", "seq")
    return by_bin.unionByName(by_end).groupBy("page_id", "item_id").agg(F.min("seq").alias("seq"))


def first_sights(items: DataFrame, windows: DataFrame) -> DataFrame:
    """page_id, item_id, seq (the first window near which the item lies) and on_screen (whether it is in sight then, hence first in line).

    ``items``: page_id, item_id, top, bottom (pixels) and, if present, action and fresh: hidden items, items without id and those with a
    fresh cache entry are not asked for. ``windows``: page_id, seq (order of scrolling), y, height. An item on a page several times counts once.
    """
    wanted = items.where("item_id is not null")
    for test in (f for c, f in (("action", "action <> 'hide'"), ("fresh", "not coalesce(fresh, false)")) if c in items.columns):
        wanted = wanted.where(test)
    near = windows.withColumns({"lo": F.col("y") - F.col("height") * X.LOOKAHEAD, "hi": F.col("y") + F.col("height") * (1 + X.LOOKAHEAD)})
    found = _seen(wanted, near)
    at = windows.groupBy("page_id", "seq").agg(F.max_by(F.struct("y", "height"), F.struct("y", "height")).alias("w"))
    sight = wanted.join(found, ["page_id", "item_id"]).join(at, ["page_id", "seq"])
    shown = (F.col("bottom") > F.col("w.y")) & (F.col("top") < F.col("w.y") + F.col("w.height"))
    return sight.groupBy("page_id", "item_id").agg(F.first("seq").alias("seq"), F.bool_or(shown).alias("on_screen"))
