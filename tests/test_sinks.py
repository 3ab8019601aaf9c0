from pyspark.sql import functions as F

from gleaner.operators import enrich, report
from gleaner.sources import files
from gleaner.streaming import feed

MATCH = "array<struct<rule_id:string,category:string,weight:int,reason:string,confidence:string,sample:string>>"
SCORED = f"item_id string, title string, price_text string, url string, action string, score int, visible_text string, matches {MATCH}"


def scored(spark):
    m = ("vendor-temu", "known-vendor", 42, "source", "high", "Temu")
    rows = [("1", "Chair", "$5", None, "hide", 88, "new chair", [m]), ("2", "Lamp", "$9", "u", "allow", 0, "old lamp", []), ("3", "Desk", "", None, "label", 30, "desk", [m])]
    return spark.createDataFrame(rows, SCORED)


def test_export_comes_back(spark, tmp_path):
    out = report.decisions(scored(spark))
    files.export_json(out, {"scanned": 7}).write.text(f"{tmp_path}/x")
    back = {r["item_id"]: r for r in files.read_export(spark, f"{tmp_path}/x").collect()}
    assert {k: (r["title"], r["price_text"], r["action"], r["score"], r["visible_text_excerpt"], r["matches"]) for k, r in back.items()} == {
        r["item_id"]: (r["title"], r["price_text"], r["action"], r["score"], r["visible_text_excerpt"], r["matches"]) for r in out.collect()
    }
    stats = spark.read.schema(files.EXPORT).json(f"{tmp_path}/x").select("stats.*", "showHidden").first()
    assert tuple(stats) == (7, 1, 0, 1, False)
    assert files.export_json(out.withColumn("page_id", F.lit(1)), by="page_id").count() == 1


def test_details_and_images_never_multiply_cards(spark):
    cards = scored(spark)
    late = cards.withColumns({"score": F.lit(95), "action": F.lit("hide"), "fetched_at": F.lit(2), "fresh": F.col("item_id") != "3"})
    early = late.withColumns({"score": F.lit(10), "fetched_at": F.lit(1)})
    got = {r["item_id"]: r for r in enrich.merge_details(cards, early.unionByName(late)).collect()}
    assert len(got) == 3 and got["2"]["score"] == 95 and got["2"]["from_details"] and not got["3"]["from_details"] and got["3"]["score"] == 30
    images = spark.createDataFrame([("a", "02", True), ("a", "01", False)], "image_url string, hash string, catalog_style boolean")
    rows = enrich.attach_images(cards.withColumn("image_url", F.lit("a")), images).collect()
    assert len(rows) == 3 and all((r["image_hash"], r["image_catalog_style"]) == ("01", False) for r in rows)


def test_upserts_are_one_table(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k, rows in enumerate([[("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], [("a", 3, "w"), ("c", 1, "v"), ("b", 4, "old")]]):
        spark.createDataFrame(rows, "item_id string, pos int, t string").coalesce(1).write.mode("append").parquet(src)
        feed.upsert_latest(feed.listing_stream(spark, src, "item_id string, pos int, t string"), out, f"{tmp_path}/cp").awaitTermination()
    assert {(r["item_id"], r["t"]) for r in feed.read_latest(spark, out).collect()} == {("a", "w"), ("b", "z"), ("c", "v")}


def test_settings_of_missing_and_broken_files(spark, tmp_path):
    assert files.read_settings(spark, f"{tmp_path}/none") == files.Settings()
    (tmp_path / "bad.json").write_text("{no json")
    assert files.read_settings(spark, f"{tmp_path}/bad.json") == files.Settings()
    files.write_settings(spark, files.Settings(aggressiveness="strict"), f"{tmp_path}/s")
    assert files.read_settings(spark, f"{tmp_path}/s").aggressiveness == "strict"
