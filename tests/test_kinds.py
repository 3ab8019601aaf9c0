"""What follows from a listing's texts is found out once for all listings of its kind."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions.settings import Settings
from gleaner.operators import report, score
from gleaner.plans import listings as L
from gleaner.plans import queries as Q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Four copies of the lines: every text occurs on several items; one supplier's name is null, two share one."""
    at = str(tmp_path_factory.mktemp("kinds"))
    lines = [(o + k * 3360, n, pk, pk % 5 + 1) for k in range(4) for o in range(60) for n, pk in ((1, o % 30), (2, o % 22), (3, 11 * o))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{at}/lineitem.parquet")
    names = {1: "Retail Co", 2: "Shop", 3: "Shop", 4: None, 5: "Supplier#5"}
    spark.createDataFrame([(i, s, i % 2) for i, s in names.items()], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(i, f"NATION {i}") for i in range(2)], "n_nationkey int, n_name string").write.parquet(f"{at}/nation.parquet")
    return at


def test_each_kind_is_scored_once(spark, tables, monkeypatch):
    seen, real = [], score.score

    def spy(df, settings=None):
        seen.append(df.count())
        return real(df, settings)

    monkeypatch.setattr(Q.S, "score", spy)
    cols = ["item_no", "item_id", "page_id", "pos", "url", *score.TEXTS, "body", "sponsored", "profile", "label", "score", "action", "matches"]
    got = sorted(map(repr, Q._scored(spark, tables).select(*cols).collect()))
    rows = L.listings(spark, tables)
    want = sorted(map(repr, real(rows).select(*cols).collect()))
    assert got == want and len(got) == 720
    assert seen == [rows.select(*score.TEXTS).distinct().count()] and seen[0] < 300


def test_counts_by_kind_are_counts_of_listings(spark, tables):
    scored = score.score(L.listings(spark, tables))
    assert sorted(map(tuple, Q.rule_catalog(spark, tables).select("rule_id", "n").collect())) == sorted(map(tuple, report.catalog_hits(scored).select("rule_id", "n").collect()))
    ladder = {r["action"]: r["n"] for r in Q.threshold_ladder(spark, tables).where("level = 'balanced' and mode = 'hide'").collect()}
    assert ladder == {r["action"]: r["count"] for r in scored.groupBy("action").count().collect()} and sum(ladder.values()) == 720


def test_look_finds_what_the_column_engine_finds(spark):
    """First matches of all rules looked for, in the letters of the text, by rule."""
    rules = score.looked_for(Settings())
    assert len(rules) > 55
    texts = ["Temu and TEMU · Ali Express", "order at Shop-1.com, wish.com", "work from home job; Remote Work income", "call me 415-555-2671 Instagram @some_one", "", None, *L.TITLES, *L.BODIES]
    want = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.regexp_extract("t", "(?i)" + p, 0).alias("sample")) for i, p in rules.items()]), lambda h: h["sample"] != "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    out = rows.select(score._GATES.look(F.col("t"), rules)["found"].alias("found"), want.alias("want")).collect()
    assert all((r["found"] or []) == (r["want"] or []) for r in out) and sum(len(r["found"]) for r in out) > 50


def test_details_without_texts_merge(spark):
    """Cards that carry no texts or matches merge what they carry."""
    from gleaner.operators.enrich import merge_details

    cards = spark.createDataFrame([("1", 10, "allow"), ("2", 30, "dim")], "item_id string, score int, action string")
    details = spark.createDataFrame([("1", 50, "hide"), ("2", 20, "label")], "item_id string, score int, action string")
    assert sorted(map(tuple, merge_details(cards, details).collect())) == [("1", 50, "hide", True), ("2", 30, "dim", False)]
