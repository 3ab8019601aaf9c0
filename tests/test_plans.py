import re
from datetime import datetime, timedelta

from gleaner.plans import queries as Q


def test_fingerprints_of_every_document(spark, tmp_path):
    texts = ["Brand  New Sofa $1,200 OBO", "Größe  NEU énew, new é", "L'été\u00a0à Paris: brand\u00a0new", "niño\tfirm\n¿Qué? $5", "İSTANBUL Kelvin \u212a ſ", "", None]
    rows = [(i, t, lang) for i, t in enumerate(texts) for lang in [("en", "de", "fr", "es")[i % 4]]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(t):
        t = re.sub(r"\s+", " ", t).strip().lower()
        t = re.sub(r"\b(?:brand\s+new|new|sealed|available|delivery|pickup|firm|obo|must\s+go)\b", "", re.sub(r"\$[\d,.]+", "", t), flags=re.A)
        return re.sub("[^a-z0-9]+", " ", t).strip()

    got = {r["doc_id"]: r["fp"] for r in Q.fingerprints(spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else brute(t) for i, t in enumerate(texts)}


def test_freshness_of_every_event(spark, tmp_path):
    now = datetime(2024, 1, 10)
    ages = [timedelta(seconds=x) for x in (0, 59, 60, 1799, 1800, 21599, 21600, -1, -20 * 86400)]
    rows = [(i, now - a, kind) for i, (a, kind) in enumerate((a, kind) for a in ages for kind in ("view", "error", "click"))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    ttl = {"view": 21600, "error": 60, "click": 1800}
    got = {r["event_id"]: r["fresh"] for r in Q.ttl_freshness(spark, str(tmp_path)).collect()}
    assert got == {i: (now - ts).total_seconds() < ttl[kind] for i, ts, kind in rows}


def test_details_of_every_item(spark, monkeypatch):
    from pyspark.sql import functions as F

    def scored(spark, sf_dir, settings=None):
        cols = ["CAST(id AS STRING) AS item_id", "id AS item_no", "'t' AS title", "'u' AS url", "array('m') AS matches"]
        return spark.range(9).selectExpr(*cols).withColumns({"score": F.lit(50 if settings else 10), "action": F.lit("hide" if settings else "allow")})

    monkeypatch.setattr(Q, "_scored", scored)
    got = Q.deep_merge(spark, "").collect()
    assert len(got) == 9 and all((r["score"], r["action"], r["from_details"]) == (50, "hide", True) for r in got)


def test_static_hits_match_each_text_once(spark, tmp_path):
    """Reposts of the same texts count, but are matched once; equal to the query's SQL."""
    import duckdb

    lines = [(o, n, pk, pk % 3 + 1) for o in range(60) for n, pk in ((1, o % 6), (2, o % 9))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"Supplier#{i}", i) for i in (1, 2, 3, 4)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, f"NATION {i}") for i in range(5)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    out = Q.static_rule_hits(spark, str(tmp_path))
    assert "count(1) AS n" in out._jdf.queryExecution().analyzed().toString().split("_gate0")[-1]
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(Q.SQL["static_rule_hits"]).fetchall()) != []


def test_listings_are_dealt_as_keys(spark, tmp_path):
    """One exchange by page, of keys, serves the grouping and the windows; texts are made after it."""
    from gleaner.plans.listings import listings

    spark.createDataFrame([(1, 1, 5, 1)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "S", 1)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "N")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    plan = listings(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "visible_text" not in plan[plan.index("Exchange hashpartitioning(") :]


def test_levels_are_scored_once(spark):
    from dataclasses import replace

    from gleaner.functions.settings import Settings
    from gleaner.operators import evaluate
    from gleaner.operators.score import score

    rows = [("Temu lamp brand new", "$20", "Bend, OR", "ships from our warehouse", "slop"), ("Oak desk", "Free", "Bend, OR", "real price $250 in description", "legit"), ("Garden bench sold", None, "", None, "legit")]
    entries = spark.createDataFrame(rows, "title string, price_text string, location_text string, body string, label string")
    for base in (Settings(), Settings(filter_mode="dim"), Settings(allow_terms=("garden bench",)), Settings(enabled=False)):
        cols = ["title", "view", "score", "action", "matches"]
        got = evaluate.evaluated(entries, base=base)
        want = [(*r, lv) for lv in evaluate.LEVELS for r in score(evaluate.views(entries), replace(base, aggressiveness=lv)).select(*cols).collect()]
        assert sorted(map(tuple, got.select(*cols, "level").collect()), key=repr) == sorted(want, key=repr)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == (3 if base.allow_terms else int(base.enabled))
