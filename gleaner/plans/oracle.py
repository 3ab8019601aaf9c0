"""The same results in plain SQL, for engines whose regular expressions know no look-around.

Rules with look-around are tested by masking: exempted phrases are blanked out first, then the plain
pattern is tried.
"""

from __future__ import annotations

import re

from gleaner.functions import fixed as X
from gleaner.functions import text as T
from gleaner.functions.settings import Settings
from gleaner.plans.listings import listings_sql

#: Phrases that the look-arounds of a rule exempt.
MASKS = {
    "vendor-amazon": [r"\bamazon\b\s*(?:echo|alexa|kindle|fire|firestick|dot|show|tap|halo|eero|basics|music|prime)"],
    "vendor-copycat-language": [r"1\s*:\s*1\s*scale"],
    "new-in-box-title": [r"(?:gold|steel|fine|medium|broad|italic|stub)\snib\b", r"\bnib\b\s*(?:size|width|section|unit)"],
    "store-showroom": [r"(?:no|not\sa|not)\sdealer", r"dealer(?:\s+plates?|\s+fees?)"],
    "store-auto-dealer-fees": [r"(?:no|or|zero|without)\sdealer\s+fees?"],
    "not-for-sale-title-request": [
        r"looking\s+for\s+(?:a\s+|its\s+|their\s+)?(?:new|good|forever)\s+home", r"seeking\s+(?:a\s+)?(?:new|good)\s+home",
        r"^wanted\b\s*(?:movie|film|poster|dvd|vhs|sign|print|dead\s+or\s+alive)",
    ],
    "not-for-sale-unavailable": [r"sold\s+(?:separately|individually|as\s+(?:a\s+)?(?:set|pair|lot)|together)"],
    "gem-condition-details": [r"works\s+with"],
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain(pattern: str) -> str:
    """Without its look-arounds."""
    while m := re.search(r"\(\?<?!", pattern):
        depth, i = 0, m.start()
        while True:
            if pattern[i] == "\\":
                i += 1
            elif pattern[i] == "(":
                depth += 1
            elif pattern[i] == ")":
                depth -= 1
                if not depth:
                    break
            i += 1
        pattern = pattern[: m.start()] + pattern[i + 1 :]
    return pattern


def hit(rule: X.Rule) -> str:
    hay = {"allText": "all_text", "title": "t_title", "title+priceText": "t_tp"}[rule.fields]
    for mask in MASKS.get(rule.id, []):
        hay = f"regexp_replace({hay}, {_q(mask)}, '~', 'gi')"
    return f"regexp_matches({hay}, {_q(plain(rule.pattern))}, 'i')"


def _norm(*cols: str) -> str:
    joined = ", ".join(f"nullif({c}, '')" for c in cols)
    return rf"trim(regexp_replace(concat_ws(' ', {joined}), '\s+', ' ', 'g'))"


def amounts_sql(col: str) -> str:
    return rf"list_transform(regexp_extract_all({col}, {_q(X.AMOUNT)}, 1), lambda a: CAST(replace(a, ',', '') AS DOUBLE))"


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {_q(pattern)}, 'i')"


def distinct_hits(col: str, pattern: str) -> str:
    return f"len(list_distinct(list_transform(regexp_extract_all({col}, {_q('(?i)' + pattern)}, 0), lambda a: lower(a))))"


def base() -> str:
    """CTEs: l (listings), b (haystacks and facts)."""
    return rf"""
l AS ({listings_sql()}),
b0 AS (SELECT *, {_norm("title", "price_text", "location_text", "seller_text", "visible_text")} AS all_text, {_norm("title")} AS t_title, {_norm("title", "price_text")} AS t_tp FROM l),
b AS (SELECT *, CASE WHEN {has("price_text", chr(92) + "bfree" + chr(92) + "b")} THEN 0.0 ELSE {amounts_sql("price_text")}[1] END AS price, {amounts_sql("all_text")} AS amounts,
  {has("all_text", X.RETAIL)} AND NOT {has("all_text", X.CONDITION)} AS retail_only FROM b0)"""


def bait() -> str:
    disclosed = has("all_text", X.PRICE_DISCLOSURE)
    spot = f"(price <= 5 OR round(price) IN ({', '.join(map(str, X.PLACEHOLDER_PRICES))}))"
    higher = "len(list_filter(amounts, lambda a: a > greatest(25.0, price * 2) AND a <> price)) > 0"
    return f"""
SELECT item_no, CASE WHEN price IS NULL THEN 'bait-price-hidden' WHEN {spot} AND ({disclosed} OR {higher}) THEN 'bait-price-gamed' ELSE 'bait-price-disclosure' END AS rule_id,
  CASE WHEN price IS NULL THEN 40 WHEN {spot} AND {higher} THEN 74 WHEN {spot} AND {disclosed} THEN 38 ELSE 30 END AS weight, price_text AS sample
FROM b WHERE CASE WHEN price IS NULL THEN {has("price_text", X.HIDDEN_PRICE)} WHEN {spot} AND ({disclosed} OR {higher}) THEN true
  ELSE {disclosed} AND price < 50 AND NOT {has("all_text", X.HUMAN_SALE)} END"""


def stuffing() -> str:
    return rf"""
SELECT item_no, CASE WHEN v >= 4 OR c >= 6 THEN 36 ELSE 26 END AS weight FROM (
  SELECT item_no, {distinct_hits("all_text", X.VENDOR_BRANDS)} AS v, {distinct_hits("lower(title)", X.CATEGORY_NOUNS)} AS c,
    len(regexp_extract_all(title, '[,|/•]', 0)) AS sep, len(string_split(trim(regexp_replace(lower(title), '\s+', ' ', 'g')), ' ')) AS n,
    len(list_distinct(string_split(trim(regexp_replace(lower(title), '\s+', ' ', 'g')), ' '))) AS u, {has("all_text", X.HUMAN_BUNDLE)} AS bundle FROM b
) WHERE v >= 4 OR (CASE WHEN n >= 12 THEN 1 - u / n ELSE 0 END) > 0.38 OR (((sep >= 9 AND n >= 10) OR (c >= 5 AND n >= 8)) AND NOT bundle)"""


def counterfeit() -> str:
    return f"""
SELECT item_no, rule_id, weight FROM (
  SELECT item_no, unnest([CASE WHEN dodge THEN 'counterfeit-authenticity-dodge' END, CASE WHEN NOT strong AND (lux + hype >= 3 OR (item AND ((lux > 0 AND price > 0 AND
    price < CASE WHEN lux + hype >= 3 THEN 300 ELSE 120 END) OR (hype > 0 AND looks_new AND price > 0 AND price < 130)))) THEN 'counterfeit-luxury-underpriced' END]) AS rule_id,
    unnest([30, CASE WHEN lux + hype >= 3 THEN 34 ELSE 28 END]) AS weight FROM (
    SELECT item_no, price, {distinct_hits("all_text", X.LUXURY_BRANDS)} AS lux, {distinct_hits("all_text", X.HYPE_BRANDS)} AS hype, {has("all_text", X.AUTHENTICITY_DODGE)} AS dodge,
      {has("all_text", X.STRONG_AUTHENTICITY)} AS strong, {has("all_text", X.LUXURY_ITEMS)} AS item, {has("all_text", X.LOOKS_NEW)} AS looks_new FROM b
  ) WHERE lux + hype > 0
) WHERE rule_id IS NOT NULL"""


def matches(settings: Settings | None = None, profile: bool = False, flood: str | None = None) -> str:
    """CTEs up to ``m``: (item_no, rule_id, category, weight, confidence), one row a match, before context adjustments."""
    s = settings or Settings()
    on = [r for r in X.RULES if s.active(r.category, r.id)]
    catalog = ", ".join(f"({_q(r.id)}, {_q(r.category)}, {r.weight}, {_q(r.confidence)})" for r in on)
    cases = ", ".join(f"CASE WHEN {hit(r)} THEN {_q(r.id)} END" for r in on)
    parts = [
        "SELECT h.item_no, h.rule_id, c.category, c.weight, c.confidence FROM hits h JOIN catalog c ON h.rule_id = c.rule_id",
        f"SELECT item_no, rule_id, 'bait-pricing', weight, CASE WHEN weight IN (74, 40) THEN 'high' ELSE 'medium' END FROM ({bait()})",
        f"SELECT item_no, 'keyword-stuffing-detected', 'keyword-stuffing', weight, CASE weight WHEN 36 THEN 'high' ELSE 'medium' END FROM ({stuffing()})",
        f"SELECT item_no, rule_id, 'counterfeit', weight, 'medium' FROM ({counterfeit()})",
        "SELECT item_no, 'missing-human-context', 'missing-human', 14, 'low' FROM b WHERE retail_only",
    ]
    if flood:
        parts.append(f"SELECT item_no, 'duplicate-flood-repeat', 'duplicate-flood', 80, 'high' FROM ({flood}) WHERE tier IS NOT NULL AND ordinal > 0")
    user = []
    for t in X.TOGGLES:
        if t.kind == "vendor" and t.id in s.block_all:
            conds = " OR ".join(hit(r) for r in X.RULES if r.id in t.rule_ids)
            user.append(f"SELECT item_no, 'block-all-{t.id}', 'custom-rules', 96, 'high' FROM b WHERE {conds}")
    for terms, rule, w in ((s.block_terms, "custom-block-term", 96), (s.vendor_terms, "custom-vendor-term", 38)):
        for term in terms:
            p = T.term_pattern(term).replace("(?=$|[^a-z0-9])", "(?:$|[^a-z0-9])")
            user.append(f"SELECT item_no, {_q(rule)}, 'custom-rules', {w}, 'high' FROM b WHERE {has('all_text', p)}")
    allow = "CASE " + "".join(f"WHEN item_id = {_q(i)} THEN 'custom-allow-item' " for i in s.allow_items)
    for term in s.allow_terms:
        p = T.term_pattern(term).replace("(?=$|[^a-z0-9])", "(?:$|[^a-z0-9])")
        allow += f"WHEN {has('all_text', p)} THEN 'custom-allow-term' "
    if s.allow_items or s.allow_terms:
        user.append(f"SELECT item_no, r, 'custom-rules', CASE r WHEN 'custom-allow-item' THEN -120 ELSE -80 END, 'high' FROM (SELECT item_no, {allow} END AS r FROM b) WHERE r IS NOT NULL")
    more = "".join(f" UNION ALL {u}" for u in user)
    return f"""{base()},
catalog(rule_id, category, weight, confidence) AS (VALUES {catalog}),
hits AS (SELECT item_no, rule_id FROM (SELECT item_no, unnest([{cases}]) AS rule_id FROM b) WHERE rule_id IS NOT NULL),
m0(item_no, rule_id, category, weight, confidence) AS ({" UNION ALL ".join(parts)}),
combo AS (SELECT DISTINCT v.item_no FROM m0 v JOIN b ON v.item_no = b.item_no WHERE v.category = 'known-vendor' AND v.weight > 0 AND (b.retail_only OR EXISTS (
  SELECT 1 FROM m0 x WHERE x.item_no = v.item_no AND x.category IN ('dropship-phrasing', 'catalog-copy') AND x.weight > 0))),
m1 AS (SELECT * FROM m0 UNION ALL SELECT item_no, 'vendor-retail-combo', 'known-vendor', 26, 'medium' FROM combo{more}),
m2 AS (SELECT *, max(weight) OVER (PARTITION BY item_no) AS top FROM m1),
m AS (SELECT m2.item_no, rule_id, category, weight, confidence FROM m2 JOIN l ON m2.item_no = l.item_no WHERE NOT (top >= 70 AND category = 'gem-positive')
  {"AND NOT (profile AND rule_id IN (" + ", ".join(map(_q, X.PROFILE_NOISY_RULES)) + "))" if profile else ""})"""


def scored(settings: Settings | None = None, **more) -> str:
    """CTEs up to ``s``: the listing columns with score, action, n_matches, rule_ids."""
    s = settings or Settings()
    label, dim, hide = X.THRESHOLDS[s.aggressiveness]
    if s.filter_mode == "label":
        ladder = f"CASE WHEN score < {label} THEN 'allow' ELSE 'label' END"
    elif s.filter_mode == "dim":
        ladder = f"CASE WHEN score < {label} THEN 'allow' WHEN score < {dim} THEN 'label' ELSE 'dim' END"
    else:
        ladder = f"CASE WHEN score < {label} THEN 'allow' WHEN score < {dim} THEN 'label' WHEN score < {hide} THEN 'dim' ELSE 'hide' END"
    return f"""{matches(s, **more)},
g AS (SELECT item_no, sum(weight) AS total, count(*) AS n, string_agg(rule_id, ',' ORDER BY rule_id) AS ids, bool_or(rule_id LIKE 'custom-allow-%') AS allowed FROM m GROUP BY item_no),
s0 AS (SELECT l.*, CAST(greatest(0, CASE WHEN coalesce(allowed, false) THEN least(total, {label - 1}) ELSE coalesce(total, 0) END) AS INTEGER) AS score,
  CAST(coalesce(n, 0) AS INTEGER) AS n_matches, coalesce(ids, '') AS rule_ids FROM l LEFT JOIN g ON l.item_no = g.item_no),
s AS (SELECT *, {ladder} AS action FROM s0)"""
