"""Scoring: every listing gets its rule matches, a score and an action.

``score(df, settings)`` is a narrow transform: haystacks are made once, in a select of their own below the
matches; inactive rules are never put into the plan. Input columns (strings, null counts as
empty): title, price_text, location_text, seller_text, visible_text; optional: item_id, text_lines
(array), duplicate (struct<group_size, ordinal, tier>), is_seller_profile, image_catalog_style.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed as X
from gleaner.functions import text as T
from gleaner.functions.gates import Gates
from gleaner.functions.settings import Settings
from gleaner.plans.shared import kept

MATCH = "struct<rule_id:string,category:string,weight:int,reason:string,confidence:string,sample:string>"
_RULES = {r.id: r for r in X.RULES}


def _match(rule_id, category, weight, reason, confidence, sample=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(rule_id).alias("rule_id"), as_col(category).alias("category"), as_col(weight).cast("int").alias("weight"),
        as_col(reason).alias("reason"), as_col(confidence).alias("confidence"), (F.lit(None) if sample is None else as_col(sample)).cast("string").alias("sample"),
    )


def _some(*cases: Column) -> Column:
    """An array of the cases that are not null."""
    return F.filter(F.array(*cases), lambda m: m.isNotNull()) if cases else F.array().cast(f"array<{MATCH}>")


def _once(c: Column, streaming: bool) -> Column:
    """``c`` behind a condition that always holds but is not deterministic.

    Catalyst moves filters below projections by inlining what they refer to, and would unfold the whole
    scoring into every filter on a score, and puts what is used once into its user, where higher-order functions run
    it uncompiled; it does neither past this. Streams allow no row numbers, but random ones.
    """
    return F.when((F.rand(0) if streaming else F.monotonically_increasing_id()) >= 0, c)


def _haystack(fields: str) -> str:
    return {"allText": "_allf", "title": "_titlef", "title+priceText": "_tpf"}[fields]


# brands are looked for in the text before folding; folded, what they match there matches this
_LUXURY_FOLDED = X.LUXURY_BRANDS.replace("[eè]", "[e·]")
_GATES = Gates([r.pattern for r in X.RULES] + [
    X.PRICE_DISCLOSURE, X.HUMAN_SALE, X.VENDOR_BRANDS, X.CATEGORY_NOUNS, X.HUMAN_BUNDLE, _LUXURY_FOLDED, X.HYPE_BRANDS, X.LOOKS_NEW, X.STRONG_AUTHENTICITY, X.LUXURY_ITEMS, X.AUTHENTICITY_DODGE, X.RETAIL, X.CONDITION,
], elsewhere=tuple(r.pattern for r in X.RULES if r.fields != "allText") + (X.CATEGORY_NOUNS,))


def _find(fields: str, pattern: str) -> Column:
    """The first match, '' if there is none or an empty one, null where the gate says that there is none."""
    found = F.regexp_extract(F.col(_haystack(fields)), "(?i)" + pattern, 0)
    can = _GATES.can(pattern)
    return found if can is None else F.when(can, found)


def _has(pattern: str) -> Column:
    can = _GATES.can(pattern)
    if pattern in _GATES.sure:
        return can
    hit = T.has(F.col("_allf"), pattern)
    return hit if can is None else can & hit


def with_text(df: DataFrame, wanted: dict[int, str] | None = None) -> DataFrame:
    """Adds the haystacks: all text, title, title and price, plain and ASCII-folded; and ``item_id``, ``text_lines`` where absent.

    ``_found`` are the first matches in all text of the ``wanted`` patterns, see ``Gates.look``.
    """
    full = {c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "price_text", "location_text", "seller_text", "visible_text") if c in df.columns}
    full |= {c: F.lit("") for c in ("title", "price_text", "location_text", "seller_text", "visible_text") if c not in df.columns}
    join = lambda *cs: T.normalize(F.concat_ws(" ", *[F.nullif(full[c], F.lit("")) for c in cs]))
    out = df.withColumns({c: v for c, v in full.items()})
    out = out.withColumns({"_all": join(*full), "_title": join("title"), "_tp": join("title", "price_text")})
    out = out.withColumns({"_allf": T.ascii_fold(F.col("_all")), "_titlef": T.ascii_fold(F.col("_title")), "_tpf": T.ascii_fold(F.col("_tp"))})
    # one scan of all text, which holds the other haystacks, tells which patterns can match at all
    out = out.withColumn("_look", _GATES.look(F.col("_allf"), wanted))
    out = out.withColumns({f"_gate{n}": F.get("_look.bits", F.lit(n)) for n in range(len(_GATES.masks))} | {"_found": F.col("_look.found")}).drop("_look")
    extra = {}
    if "text_lines" not in df.columns:
        extra["text_lines"] = F.lit(None).cast("array<string>")
    if "item_id" not in df.columns:
        extra["item_id"] = F.lit(None).cast("string")
    return out.drop("_tp").withColumns(extra) if extra else out.drop("_tp")


TEXTS = ("title", "price_text", "location_text", "seller_text", "visible_text")


def dealt(texts: DataFrame) -> DataFrame:
    """Distinct texts dealt to all cores: few bytes, but much work."""
    spark = texts.sparkSession
    return texts.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def looked_for(settings: Settings) -> dict[int, str]:
    """Active static rules that the look at all text decides and samples, by their place."""
    return {i: r.pattern for i, r in enumerate(X.RULES) if settings.active(r.category, r.id) and r.fields == "allText" and r.pattern in _GATES.sure}


def with_hits(df: DataFrame, settings: Settings) -> DataFrame:
    """``df`` (``with_text`` of the rules ``looked_for``) and ``_hits`` of the active static rules: array<struct<i, sample>> by place; rules not looked for take one regular expression each."""
    looked = looked_for(settings)
    tries = [F.struct(F.lit(i).alias("i"), _find(r.fields, r.pattern).alias("sample")) for i, r in enumerate(X.RULES) if i not in looked and settings.active(r.category, r.id)]
    rest = _once(F.filter(F.array(*tries), lambda h: h["sample"] != ""), df.isStreaming) if tries else F.array().cast("array<struct<i:int,sample:string>>")
    out = df.withColumn("_rest", rest)
    return out.withColumn("_hits", F.when(F.size("_rest") == 0, F.col("_found")).otherwise(F.sort_array(F.concat("_found", "_rest")))).drop("_rest")


def static_matches(hits: Column) -> Column:
    """Full matches of ``_hits``: the catalog is a handful of constant arrays."""
    of = lambda k: F.array(*[F.lit(getattr(r, k)) for r in X.RULES])
    return F.transform(
        hits,
        lambda h: _match(*[F.get(of(k), h["i"]) for k in ("id", "category", "weight", "reason", "confidence")], h["sample"]),
    )


def bait_match(settings: Settings) -> Column:
    if not settings.active("bait-pricing", "bait-price-dynamic"):
        return F.lit(None).cast(MATCH)
    shown, allf, p = F.col("price_text"), F.col("_allf"), F.col("_price")
    disclosed = _has(X.PRICE_DISCLOSURE)
    placeholder = (p <= 5) | F.round(p).isin(*map(float, X.PLACEHOLDER_PRICES))
    higher = F.exists(T.amounts(allf), lambda a: (a > F.greatest(F.lit(25.0), p * 2)) & (a != p))
    m = lambda rule, w, reason, conf: _match(rule, "bait-pricing", w, reason, conf, shown)
    return (
        F.when(p.isNull(), F.when(T.has(shown, X.HIDDEN_PRICE), m("bait-price-hidden", 40, "hidden/contact price", "high")))
        .when(placeholder & higher, m("bait-price-gamed", 74, "bait/display price mismatch", "high"))
        .when(placeholder & disclosed, m("bait-price-gamed", 38, "bait/display price mismatch", "medium"))
        .when(disclosed & (p < 50) & ~_has(X.HUMAN_SALE), m("bait-price-disclosure", 30, "price disclosed elsewhere", "medium"))
    )


def _distinct_hits(c: Column, pattern: str, known: str | None = None) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("(?i)" + pattern), F.lit(0)), F.lower))
    can = _GATES.can(known or pattern)
    return found if can is None else F.when(can, found).otherwise(F.array().cast("array<string>"))


def _shown_title() -> Column:
    return F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("visible_text"))


def with_signs(df: DataFrame) -> DataFrame:
    """``with_text`` and what several computed rules look at: displayed price, retail wording alone, the title's words."""
    words = F.filter(F.split(T.normalize(F.lower(_shown_title())), " "), lambda w: w != "")
    return df.withColumns({"_price": _once(T.displayed_price(F.col("price_text")), df.isStreaming), "_retail_only": _retail_only(), "_words": _once(words, df.isStreaming)})


def stuffing_match(settings: Settings) -> Column:
    if not settings.active("keyword-stuffing", "keyword-stuffing-detected"):
        return F.lit(None).cast(MATCH)
    title, words = _shown_title(), F.col("_words")
    n = F.size(words)
    vendors = F.size(_distinct_hits(F.col("_allf"), X.VENDOR_BRANDS))
    nouns = F.size(_distinct_hits(T.ascii_fold(F.lower(title)), X.CATEGORY_NOUNS))
    marks = F.length(title) - F.length(F.translate(title, ",|/•", ""))
    bundle = _has(X.HUMAN_BUNDLE)
    repetition = F.when(n >= 12, 1 - F.size(F.array_distinct(words)) / n).otherwise(0.0)
    fires = (vendors >= 4) | (repetition > 0.38) | ((((marks >= 9) & (n >= 10)) | ((n >= 8) & (nouns >= 5))) & ~bundle)
    blatant = (vendors >= 4) | (nouns >= 6)
    return F.when(
        fires,
        _match("keyword-stuffing-detected", "keyword-stuffing", F.when(blatant, 36).otherwise(26), "keyword stuffing", F.when(blatant, "high").otherwise("medium"), F.substring(title, 1, 90)),
    )


def counterfeit_matches(settings: Settings) -> list[Column]:
    # one switch governs both matches
    if not settings.active("counterfeit", "counterfeit-luxury-underpriced"):
        return []
    text, allf, p = F.col("_all"), F.col("_allf"), F.col("_price")
    # these patterns hold an accented letter, so they run on the unfolded text
    luxury = _distinct_hits(text, X.LUXURY_BRANDS.replace("[eè]", "[eèÈ]"), _LUXURY_FOLDED)
    hype = _distinct_hits(allf, X.HYPE_BRANDS)
    brands = F.size(luxury) + F.size(hype)
    stack = brands >= 3
    cheap_luxury = (F.size(luxury) > 0) & (p > 0) & (p < F.when(stack, 300).otherwise(120))
    cheap_hype = (F.size(hype) > 0) & _has(X.LOOKS_NEW) & (p > 0) & (p < 130)
    cheap = F.coalesce(cheap_luxury, F.lit(False)) | F.coalesce(cheap_hype, F.lit(False))
    fires = ~_has(X.STRONG_AUTHENTICITY) & (stack | (_has(X.LUXURY_ITEMS) & cheap))
    dodge = F.when(brands > 0, _find("allText", X.AUTHENTICITY_DODGE))
    return [
        F.when(dodge != "", _match("counterfeit-authenticity-dodge", "counterfeit", 30, "authenticity dodge on branded item", "medium", dodge)),
        F.when(
            (brands > 0) & fires,
            _match(
                "counterfeit-luxury-underpriced", "counterfeit", F.when(stack, 34).otherwise(28),
                F.when(stack, "stacked luxury brands").otherwise("suspicious price for branded item"), "medium", F.array_join(F.slice(F.array_union(luxury, hype), 1, 4), ", "),
            ),
        ),
    ]


def flood_match(settings: Settings, columns: list[str]) -> Column:
    if "duplicate" not in columns or not settings.active("duplicate-flood", "duplicate-flood-dynamic"):
        return F.lit(None).cast(MATCH)
    d = F.col("duplicate")
    reason = F.concat(F.lit("repeat of a visible listing ("), d["ordinal"] + 1, F.lit(" of "), d["group_size"], F.lit(" identical)"))
    return F.when(d["tier"].isNotNull() & (d["ordinal"] > 0), _match("duplicate-flood-repeat", "duplicate-flood", 80, reason, "high"))


def sponsored_match(settings: Settings) -> Column:
    if not settings.active("store-business", "store-sponsored-card"):
        return F.lit(None).cast(MATCH)
    lines = F.when(F.size("text_lines") > 0, F.col("text_lines")).otherwise(F.split("visible_text", "\r?\n"))
    # few texts hold the word at all
    lines = F.filter(F.when((F.size("text_lines") > 0) | T.holds(F.col("visible_text"), X.SPONSORED_LINE), lines), lambda x: T.holds(x, X.SPONSORED_LINE))
    line = F.get(F.filter(F.transform(lines, T.normalize), lambda x: T.has(x, X.SPONSORED_LINE)), F.lit(0))
    return F.when(line.isNotNull(), _match("store-sponsored-card", "store-business", 74, "sponsored marketplace ad", "high", line))


def _retail_only() -> Column:
    return _has(X.RETAIL) & ~_has(X.CONDITION)


def missing_human_match(settings: Settings) -> Column:
    if not settings.active("missing-human", "missing-human-context"):
        return F.lit(None).cast(MATCH)
    return F.when(
        F.col("_retail_only"), _match("missing-human-context", "missing-human", 14, "commercial text without condition detail", "low", F.substring("_all", 1, 90))
    )


def photo_match(settings: Settings, columns: list[str]) -> Column:
    if "image_catalog_style" not in columns or not settings.active("catalog-copy", "image-catalog-photo"):
        return F.lit(None).cast(MATCH)
    return F.when(F.col("image_catalog_style"), _match("image-catalog-photo", "catalog-copy", 18, "retailer-style stock photo", "medium"))


def combo_match(settings: Settings, so_far: Column) -> Column:
    if not settings.active("known-vendor", "vendor-retail-combo"):
        return F.lit(None).cast(MATCH)
    vendor = F.get(F.filter(so_far, lambda m: (m["category"] == "known-vendor") & (m["weight"] > 0)), F.lit(0))
    retail = F.exists(so_far, lambda m: m["category"].isin("dropship-phrasing", "catalog-copy") & (m["weight"] > 0)) | F.col("_retail_only")
    return F.when(
        vendor.isNotNull() & retail, _match("vendor-retail-combo", "known-vendor", 26, "vendor source + retail-style wording", "medium", vendor["sample"])
    )


def user_matches(settings: Settings) -> list[Column]:
    """Block-all toggles, custom block and vendor terms."""
    if not settings.category_on("custom-rules"):
        return []
    out = []
    for t in X.TOGGLES:
        if t.kind == "vendor" and t.id in settings.block_all:
            rules = [_RULES[r] for r in t.rule_ids if r in _RULES]
            sample = F.coalesce(*[F.nullif(_find(r.fields, r.pattern), F.lit("")) for r in rules])
            out.append(F.when(sample.isNotNull(), _match(f"block-all-{t.id}", "custom-rules", 96, f"your “{t.label}: Hide all” setting", "high", sample)))
    for terms, rule, weight, what in ((settings.block_terms, "custom-block-term", 96, "custom block"), (settings.vendor_terms, "custom-vendor-term", 38, "custom vendor")):
        for term in terms:
            if pattern := T.term_pattern(term):
                out.append(F.when(T.holds(F.col("_lower"), pattern) & T.has(F.col("_lower"), pattern), _match(rule, "custom-rules", weight, f"{what}: {term}", "high", term)))
    return out


def allow_match(settings: Settings) -> Column:
    """The allowed item, else the first allow term that fits."""
    out = F.lit(None).cast(MATCH)
    if not settings.category_on("custom-rules"):
        return out
    for term in reversed(settings.allow_terms):
        if pattern := T.term_pattern(term):
            out = F.when(T.holds(F.col("_lower"), pattern) & T.has(F.col("_lower"), pattern), _match("custom-allow-term", "custom-rules", -80, f"allowlist: {term}", "high", term)).otherwise(out)
    if settings.allow_items:
        item = F.col("item_id").cast("string")
        out = F.when(item.isin(*settings.allow_items), _match("custom-allow-item", "custom-rules", -120, F.concat(F.lit("allow item: "), item), "high", item)).otherwise(out)
    return out


def action_of(score: Column, settings: Settings) -> Column:
    label, dim, hide = X.THRESHOLDS[settings.aggressiveness]
    if settings.filter_mode == "label":
        return F.when(score < label, "allow").otherwise("label")
    ladder = F.when(score < label, "allow").when(score < dim, "label")
    return ladder.otherwise("dim") if settings.filter_mode == "dim" else ladder.when(score < hide, "dim").otherwise("hide")


ACTION_RANK = {"allow": 0, "label": 1, "dim": 2, "hide": 3}


def strongest_first(matches: Column) -> Column:
    """Matches by absolute weight, larger first; equal ones keep their order."""
    keyed = F.transform(matches, lambda m, i: F.struct((-F.abs(m["weight"])).alias("w"), i.alias("i"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda x: x["m"])


def looked_at(columns: list[str], settings: Settings) -> list[str]:
    """Of the given columns those that ``found`` looks at."""
    return [c for c in (*TEXTS, "text_lines", "image_catalog_style", *(["item_id"] if settings.allow_items else [])) if c in columns]


def digest(*cols: str) -> Column:
    """A SHA-256 of the columns, 32 bytes: rows that agree in it agree in them."""
    text = lambda c: F.col(c).cast("string") if c in (*TEXTS, "item_id") or c.startswith("_") else F.to_json(F.struct(c))
    return F.unhex(F.sha2(F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in cols]), 256))


def found(df: DataFrame, settings: Settings) -> DataFrame:
    """``df`` and what its texts tell: ``_m`` (all matches but those of floods, in their order), ``_at`` (how many come before a flood's) and ``_allowed``."""
    given = df.columns
    hold = lambda c: _once(c, df.isStreaming)
    out = with_hits(with_signs(with_text(df, looked_for(settings))), settings).withColumn("_lower", hold(F.lower("_all")))
    before = [bait_match(settings), stuffing_match(settings), *counterfeit_matches(settings)]
    dynamic = [*before, sponsored_match(settings), missing_human_match(settings), photo_match(settings, given)]
    user = user_matches(settings)
    out = out.withColumns({"_allow": hold(allow_match(settings)), **{f"_d{k}": hold(m) for k, m in enumerate(dynamic)}, **{f"_u{k}": hold(m) for k, m in enumerate(user)}})
    at = sum((F.col(f"_d{k}").isNotNull().cast("int") for k in range(len(before))), F.size("_hits"))
    out = out.withColumn("_m", F.concat(static_matches(F.col("_hits")), _some(*[F.col(f"_d{k}") for k in range(len(dynamic))])))
    out = out.withColumn("_m", F.concat("_m", _some(combo_match(settings, F.col("_m")), *[F.col(f"_u{k}") for k in range(len(user))], F.col("_allow"))))
    return out.withColumns({"_at": at, "_allowed": F.col("_allow").isNotNull()})


def judged(df: DataFrame, settings: Settings) -> DataFrame:
    """``df`` (what was ``found``; with ``duplicate`` and ``is_seller_profile`` if known) with score, action and matches."""
    all_, flood = F.col("_m"), flood_match(settings, df.columns)
    if "duplicate" in df.columns:
        # one flood match, in its place
        df = df.withColumn("_flood", flood)
        all_ = F.when(F.col("_flood").isNull(), all_).otherwise(F.concat(F.slice("_m", F.lit(1), F.col("_at")), F.array("_flood"), F.slice("_m", F.col("_at") + 1, F.size("_m"))))
        df = df.withColumn("_m", _once(all_, df.isStreaming)).drop("_flood")
    # a definitive signal voids the signs of a find; on a seller's profile, three rules are noise
    definite = F.exists("_m", lambda m: m["weight"] >= 70)
    kept = F.when(definite, F.filter("_m", lambda m: m["category"] != "gem-positive")).otherwise(F.col("_m"))
    if "is_seller_profile" in df.columns:
        quiet = F.filter(kept, lambda m: ~m["rule_id"].isin(*X.PROFILE_NOISY_RULES))
        kept = F.when(F.coalesce("is_seller_profile", F.lit(False)), quiet).otherwise(kept)
    out = df.withColumn("_m", _once(kept, df.isStreaming))
    total = F.aggregate("_m", F.lit(0), lambda a, m: a + m["weight"])
    cap = X.THRESHOLDS[settings.aggressiveness][0] - 1
    capped = F.when(F.col("_allowed"), F.least(total, F.lit(cap))).otherwise(total)
    out = out.withColumn("score", F.greatest(F.lit(0), capped).cast("int"))
    return out.withColumns({"action": action_of(F.col("score"), settings), "matches": strongest_first(F.col("_m"))})


def score(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``df`` with score (int), action and matches (strongest first)."""
    settings = settings or Settings()
    if not settings.enabled:
        return df.withColumns({"score": F.lit(0), "action": F.lit("allow"), "matches": F.array().cast(f"array<{MATCH}>")})
    return judged(found(df, settings), settings).select(*[c for c in df.columns if c not in ("score", "action", "matches")], "score", "action", "matches")


def score_once(df: DataFrame, settings: Settings | None = None, tell=None) -> DataFrame:
    """``score``, where each distinct set of what scoring looks at is scored once; rows meet their verdicts by digest.

    ``tell`` makes of the scored sets what is wanted of them besides their digest ``_text`` (default: score, action and matches); that is written to the shared folder.
    """
    settings = settings or Settings()
    by = [*looked_at(df.columns, settings), *[c for c in ("duplicate", "is_seller_profile") if c in df.columns]]
    sets = dealt(df.select(*by).distinct()).withColumn("_text", digest(*by))
    told = (tell or (lambda scored: scored.select("_text", "score", "action", "matches")))(score(sets, settings))
    known = kept(told, "verdicts")
    return df.drop(*[c for c in known.columns if c != "_text"]).withColumn("_text", digest(*by)).join(known, "_text").drop("_text")
