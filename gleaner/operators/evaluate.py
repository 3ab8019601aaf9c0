"""Evaluation against labelled listings: confusion counts, rule noise, the gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed as X
from gleaner.functions.settings import Settings
from gleaner.operators.flood import analyze_flood
from gleaner.operators.report import tally
from gleaner.operators.score import action_of, score

LEVELS = ("relaxed", "balanced", "strict")


def views(entries: DataFrame) -> DataFrame:
    """Each entry as a card (price, title, place) and in detail (with its body)."""
    lines = lambda *cs: F.filter(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in cs]), lambda x: x != "")
    card = lines("price_text", "title", "location_text")
    both = F.array(F.struct(F.lit("card").alias("view"), card.alias("lines")), F.struct(F.lit("detail").alias("view"), F.concat(card, F.filter(F.split(F.coalesce("body", F.lit("")), "\r?\n"), lambda x: x != "")).alias("lines")))
    return entries.withColumn("_v", F.explode(both)).withColumns({"view": F.col("_v.view"), "text_lines": F.col("_v.lines"), "visible_text": F.array_join("_v.lines", "\n")}).drop("_v")


def evaluated(entries: DataFrame, levels=LEVELS, base: Settings | None = None) -> DataFrame:
    """Every entry in both views at every level: label, level, view, score, action, matches."""
    from dataclasses import replace

    seen, base = views(entries), base or Settings()
    if not (base.enabled and (base.allow_terms or base.allow_items)):
        # only what is allowed is scored by level; all else is scored once, and its actions follow
        once = score(seen, replace(base, aggressiveness=levels[0]))
        if len(levels) == 1 or not base.enabled:
            ways = [F.struct(F.lit(lv).alias("level"), F.col("action").alias("action")) for lv in levels]
        else:
            ways = [F.struct(F.lit(lv).alias("level"), action_of(F.col("score"), replace(base, aggressiveness=lv)).alias("action")) for lv in levels]
        return once.withColumn("_w", F.explode(F.array(*ways))).withColumns({"action": F.col("_w.action"), "level": F.col("_w.level")}).drop("_w")
    parts = [score(seen, replace(base, aggressiveness=lv)).withColumn("level", F.lit(lv)) for lv in levels]
    return reduce(DataFrame.unionByName, parts)


def confusion(results: DataFrame, weight: str | None = None) -> DataFrame:
    return results.groupBy("level", "view", "label", "action").agg(tally(F.lit(True), weight).alias("n"))


def percent(part, whole):
    return F.when(whole == 0, "n/a").otherwise(F.concat(F.format_string("%.1f", 100 * part / whole), F.lit("%")))


def rule_noise(results: DataFrame, labels=("legit", "slop", "borderline"), weight: str | None = None) -> DataFrame:
    """Positive matches of each rule by label; ``noisiest_first`` orders them."""
    rows = results.select("label", *([weight] if weight else []), F.explode("matches").alias("m")).where("m.weight > 0")
    return rows.groupBy(F.col("m.rule_id").alias("rule_id")).agg(*[tally(F.col("label") == x, weight).alias(x) for x in labels])


def noisiest_first(noise: DataFrame) -> DataFrame:
    """Rules by their matches on legit entries, then on slop (one row a rule)."""
    return noise.orderBy(F.desc("legit"), F.desc("slop"), "rule_id")


def gate(results: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: legit entries hidden or dimmed at the balanced level (those marked as a matter of taste aside), and whether the gate holds."""
    bad = (F.col("level") == "balanced") & (F.col("label") == "legit") & F.col("action").isin("hide", "dim")
    if "vendorTaste" in results.columns:
        bad = bad & F.col("vendorTaste").isNull()
    return results.agg(tally(bad, weight).alias("hard_failures")).withColumn("passed", F.col("hard_failures") == 0)


def taste_failures(entries: DataFrame) -> DataFrame:
    """Legit entries of a taste that the default settings do not act on as cards: ikea must be hidden, any other dimmed at least."""
    seen = score(views(entries.where("label = 'legit' and vendorTaste is not null")).where("view = 'card'"), Settings())
    return seen.where((F.col("action") != "hide") & ((F.col("vendorTaste") == "ikea") | (F.col("action") != "dim")))


def permissive_failures(entries: DataFrame) -> DataFrame:
    """Legit entries, in both views, that stay hidden or dimmed when the choices of taste are taken back."""
    open_minded = Settings(block_all=(), disabled_rules=(X.NEW_IN_BOX_RULE,))
    return score(views(entries.where("label = 'legit'")), open_minded).where(F.col("action").isin("hide", "dim"))


def flood_failures(pages: DataFrame) -> DataFrame:
    """page_id of pages on which a listing's action is not the ``expected`` one (null: allow).

    ``pages`` are listings with page_id, pos, expected and is_seller_profile; sellers' own pages are no floods.
    """
    own = F.coalesce("is_seller_profile", F.lit(False))
    seen = analyze_flood(pages)
    none = F.struct(F.lit(1).alias("group_size"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("tier"))
    seen = seen.withColumn("duplicate", F.when(own, none).otherwise(F.col("duplicate")))
    return score(seen, Settings()).where(F.col("action") != F.coalesce("expected", F.lit("allow"))).select("page_id").distinct()


def full_gate(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: failures of each kind (legit, taste, permissive, flood), their sum and whether the gate holds."""
    hard = gate(evaluated(entries, ("balanced",))).select(F.lit("legit").alias("kind"), F.col("hard_failures").alias("n"))
    for kind, rows in (("taste", taste_failures(entries)), ("permissive", permissive_failures(entries)), ("flood", flood_failures(pages))):
        hard = hard.unionByName(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n"))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k)
    out = hard.agg(*[of(k) for k in ("legit", "taste", "permissive", "flood")], F.sum("n").alias("hard_failures"))
    return out.withColumn("passed", F.col("hard_failures") == 0)


def require_unique_ids(entries: DataFrame, id_col: str = "id") -> DataFrame:
    """Raises if an id repeats."""
    twice = entries.groupBy(id_col).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate id: {twice[0][0]}")
    return entries
