import pytest

from gleaner.functions.settings import Settings
from gleaner.operators.flood import analyze_flood
from gleaner.operators.score import score

CASES = [
    ("plain", "Oak shelf", "$40", "good condition, pickup today", "allow"),
    ("sold", "Bike - SOLD", "$40", "", "hide"),
    ("sold set", "Chairs sold as a set", "$40", "", "allow"),
    ("wanted", "ISO drum kit", "$1", "", "hide"),
    ("bait", "Couch", "$1", "real price $400 in description", "hide"),
    ("amazon", "Lamp from amazon", "$20", "works", "allow"),
    ("gift cards", "Phone", "$50", "pay with gift cards", "hide"),
    ("ikea", "IKEA desk", "$30", "used", "hide"),
    ("no dealer", "Truck", "$9000", "no dealer please, one owner", "allow"),
    ("empty", "", "", "", "allow"),
    ("nulls", None, None, None, "allow"),
]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(n, t, p, b) for n, t, p, b, _ in CASES]
    return {r["name"]: r for r in score(spark.createDataFrame(rows, "name string, title string, price_text string, visible_text string")).collect()}


@pytest.mark.parametrize("name,want", [(c[0], c[4]) for c in CASES])
def test_actions(scored, name, want):
    assert scored[name]["action"] == want, scored[name]


def test_strongest_first_and_samples(scored):
    m = scored["bait"]["matches"]
    assert [abs(x["weight"]) for x in m] == sorted((abs(x["weight"]) for x in m), reverse=True)
    assert m[0]["rule_id"] == "bait-price-gamed" and m[0]["sample"] == "$1"


def test_disabled_and_allow(spark):
    df = spark.createDataFrame([("1", "Bike SOLD", "$5", "garden bench")], "item_id string, title string, price_text string, visible_text string")
    assert score(df, Settings(enabled=False)).first()["action"] == "allow"
    assert score(df, Settings(allow_items=("1",))).first()["score"] == 0
    capped = score(df, Settings(allow_terms=("garden bench",))).first()
    assert capped["action"] == "allow" and capped["score"] <= 19


def test_flood_thresholds(spark):
    def page(n):
        return [(1, i, str(i), "Solid walnut sideboard cabinet", "$50", "Bend, OR", "x") for i in range(n)]

    schema = "page_id long, pos long, item_id string, title string, price_text string, location_text string, visible_text string"
    three = analyze_flood(spark.createDataFrame(page(3), schema)).collect()
    assert all(r["duplicate"]["tier"] is None for r in three)
    four = sorted(analyze_flood(spark.createDataFrame(page(4), schema)).collect(), key=lambda r: r["pos"])
    assert [r["duplicate"]["ordinal"] for r in four] == [0, 1, 2, 3] and four[0]["duplicate"]["tier"] == "exact"
    clones = analyze_flood(spark.createDataFrame([(1, i, "7", "Solid walnut sideboard cabinet", "$50", "Bend, OR", "x") for i in range(5)], schema)).collect()
    assert all(r["duplicate"]["tier"] is None for r in clones)


def test_flood_images(spark):
    rows = [(1, i, str(i), "Solid walnut sideboard cabinet", f"${50 + i}", f"Town{i}, OR", "x", f"{0xABCDEF0000 + (1 << (i % 3)):016x}") for i in range(5)]
    schema = "page_id long, pos long, item_id string, title string, price_text string, location_text string, visible_text string, image_hash string"
    got = sorted(analyze_flood(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r["pos"])
    assert {r["duplicate"]["tier"] for r in got} == {"image"} and [r["duplicate"]["ordinal"] for r in got] == list(range(5))


def test_rule_tester_and_search(spark):
    from gleaner.operators import report

    texts = [(1, "\n  Temu lamp, new \nships from our warehouse  ", None, "$12"), (2, "", " ", ""), (3, None, "Own title", None)]
    got = {r["n"]: r for r in report.try_rules(spark.createDataFrame(texts, "n int, text string, title string, price_text string")).collect()}
    assert got[1]["title"] == "Temu lamp, new " and got[1]["action"] != "allow" and got[2]["title"] == "" and got[3]["title"] == "Own title" and got[3]["findings"] == []
    assert any(f.startswith("+32 · Temu/source mention (known-vendor) · vendor-temu · high · matched") for f in got[1]["findings"])
    found = report.search_rules(report.rule_catalog(spark), "  TEMU ")
    assert [r["rule_id"] for r in found.collect()] == ["vendor-temu"]
    from pyspark.sql import functions as F

    from gleaner.functions import text as T

    urls = ["https://www.facebook.com/marketplace/profile/7/", "https://www.facebook.com/x?ref=marketplace_profile", "https://x.example/?ref=other", "no url ref=marketplace_profile", None]
    seen = spark.createDataFrame([(u,) for u in urls], "u string").coalesce(1).select(T.is_seller_profile(F.col("u"))).collect()
    assert [r[0] for r in seen] == [True, True, False, True, False]
