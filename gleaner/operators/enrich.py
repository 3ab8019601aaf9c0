"""Cards joined with what was found later: details by item, photo analyses by address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_details(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Scored cards with scored details of the same item: the stronger verdict, the card's on a tie.

    Of score, action, matches, title and url those that the cards have are merged. Of several detail rows of an item the one with the latest ``fetched_at`` counts (without that column, the strongest); rows
    whose ``fresh`` is not true do not count. The join is an equi-join on the item; Spark broadcasts
    the details only under its size threshold.
    """
    if "fresh" in details.columns:
        details = details.where("fresh")
    kept = [c for c in ("score", "action", "matches", "title", "url") if c in cards.columns]
    order = F.struct(*[c for c in ("fetched_at", "score", "action", "url", "title") if c in details.columns])
    details = details.where("item_id is not null").groupBy("item_id").agg(F.max_by(F.struct(*kept), order).alias("d")).select("item_id", "d.*")
    d = details.select(F.col("item_id").alias("_item"), *[F.col(c).alias(f"_{c}") for c in kept])
    out = cards.join(d, F.col("item_id") == F.col("_item"), "left")
    wins = F.coalesce(F.col("_score") > F.col("score"), F.lit(False))
    pick = {c: F.when(wins, F.col(f"_{c}")).otherwise(F.col(c)) for c in kept if c != "url"} | {"from_details": wins}
    if "url" in kept:
        pick["url"] = F.coalesce(F.when(wins, F.col("_url")), F.col("url"))
    return out.withColumns(pick).select(*cards.columns, "from_details")


def attach_images(cards: DataFrame, images: DataFrame) -> DataFrame:
    """Cards with image_hash and image_catalog_style of their photo (image_url, hash, catalog_style); of several analyses the one of the lowest hash."""
    one = F.min_by(F.struct("hash", "catalog_style"), F.struct("hash", "catalog_style")).alias("i")
    i = images.groupBy("image_url").agg(one).select("image_url", F.col("i.hash").alias("image_hash"), F.col("i.catalog_style").alias("image_catalog_style"))
    return cards.drop("image_hash", "image_catalog_style").join(i, "image_url", "left")


def to_fetch(cards: DataFrame, cache: DataFrame) -> DataFrame:
    """Items of cards that are not hidden and have no fresh cache entry, each once."""
    fresh = cache.where("fresh").select("item_id")
    return cards.where("action <> 'hide' and item_id is not null").dropDuplicates(["item_id"]).join(fresh, "item_id", "left_anti")
