"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import fixed as X
from gleaner.functions.gates import gate

#: White space in the wide sense: blanks, controls, no-break and typographic spaces, byte-order mark.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


#: Runs of white space that are not one blank already; what is plain fails at its first, cheapest test.
_UNEVEN = f"[^!-~](?<={SPACE})(?:(?<! ){SPACE}*|{SPACE}+)"


def normalize(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, _UNEVEN, " "))


def ascii_fold(c: Column) -> Column:
    """Each non-ASCII character becomes one filler that is no word character, so ``\\b`` sees ASCII words."""
    return F.regexp_replace(c, "[^\\x00-\\x7F]", "·")


def find(c: Column, pattern: str) -> Column:
    """The first match (case-insensitive), null if there is none or an empty one."""
    return F.nullif(F.regexp_substr(c, F.lit("(?i)" + pattern)), F.lit(""))


def has(c: Column, pattern: str) -> Column:
    return c.rlike("(?i)" + pattern)


def holds(c: Column, pattern: str) -> Column:
    """Whether a text holds the literals that the pattern needs, in lower case, and so can match at all."""
    can = gate(F.lower(c), pattern)
    return F.lit(True) if can is None else can


def amounts(c: Column) -> Column:
    """All dollar amounts of a text, as doubles."""
    found = F.regexp_extract_all(c, F.lit(X.AMOUNT), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def displayed_price(c: Column) -> Column:
    """0 for free, else the first dollar amount, else null."""
    return F.when(has(c, r"\bfree\b"), F.lit(0.0)).otherwise(F.get(amounts(c), F.lit(0)))


def fingerprint(c: Column) -> Column:
    """Lower case without amounts and sales words; anything but letters and digits is one space."""
    t = F.regexp_replace(F.lower(normalize(c)), r"\$[\d,.]+", "")
    t = F.regexp_replace(ascii_fold(t), X.FINGERPRINT_DROP, "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def redact(c: Column) -> Column:
    t = F.regexp_replace(normalize(c), "(?i)" + X.EMAIL, "[email]")
    return F.regexp_replace(t, X.PHONE, "[phone]")


def allow_term(title: Column) -> Column:
    """A title short enough and telling enough to be an allow term, else null."""
    term = F.trim(F.substring(normalize(title), 1, 90))
    words = F.regexp_extract_all(F.lower(term), F.lit("([a-z0-9]{2,})"), F.lit(1))
    telling = F.filter(words, lambda w: ~w.isin(*X.GENERIC_TITLE_WORDS))
    return F.when(F.size(telling) >= 2, term)


def escape(text: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


def term_pattern(term: str) -> str | None:
    """Pattern of a user's term: its words joined by blanks or . _ / -, whole words where its ends are alphanumeric."""
    words = term.lower().split()
    if not words:
        return None
    body = r"[\s._/-]+".join(map(escape, words))
    left = "(?:^|[^a-z0-9])" if re.match("[a-z0-9]", words[0]) else ""
    right = "(?=$|[^a-z0-9])" if re.search("[a-z0-9]$", words[-1]) else ""
    return left + body + right


def item_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/marketplace/(?:shops/|np/)?item/([^/?#]+)", 1), F.lit(""))


def canonical_url(id_hint: Column, url: Column) -> Column:
    """The item's own address, else the url without query and fragment, else null."""
    plain = F.when(F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull(), F.regexp_replace(url, "[?#].*$", ""))
    return F.when(id_hint.isNotNull(), F.concat(F.lit("https://www.facebook.com/marketplace/item/"), id_hint, F.lit("/"))).otherwise(plain)


def is_seller_profile(url: Column) -> Column:
    path, ref = F.try_parse_url(url, F.lit("PATH")), F.try_parse_url(url, F.lit("QUERY"), F.lit("ref"))
    known = F.contains(path, F.lit("/marketplace/profile/")) | F.coalesce(ref == "marketplace_profile", F.lit(False))
    rough = F.contains(url, F.lit("/marketplace/profile/")) | F.contains(url, F.lit("ref=marketplace_profile"))
    return F.coalesce(F.when(path.isNotNull(), known).otherwise(rough), F.lit(False))


def normalize_price(c: Column) -> Column:
    """'' / 'free' / the first number without commas / the lower-cased text."""
    t = F.lower(normalize(c))
    number = F.regexp_extract(t, r"(\d[\d,]*(?:\.\d{1,2})?)", 1)
    return F.when(t == "", "").when(t.rlike(r"\bfree\b"), "free").when(number != "", F.replace(number, F.lit(","), F.lit(""))).otherwise(t)


def is_bait_price(c: Column) -> Column:
    p = normalize_price(c)
    return (p == "free") | F.coalesce(p.try_cast("double") <= 5, F.lit(False))


def flood_fingerprint(title: Column, visible_text: Column) -> Column:
    """The fingerprint if it is long and telling enough, else ''."""
    fp = fingerprint(F.coalesce(F.nullif(title, F.lit("")), visible_text, F.lit("")))
    words = F.filter(F.split(fp, " "), lambda w: (F.length(w) >= 2) & ~w.isin(*X.GENERIC_FINGERPRINT_WORDS))
    return F.when((F.length(fp) >= 12) & (F.size(words) >= 3), fp).otherwise("")


def control_rule(rule_id: Column) -> Column:
    """The control that governs a match's rule; null for block-all."""
    return (
        F.when(rule_id.startswith("block-all-"), F.lit(None).cast("string"))
        .when(rule_id.startswith("bait-price-"), "bait-price-dynamic")
        .when(rule_id.startswith("duplicate-flood-"), "duplicate-flood-dynamic")
        .otherwise(rule_id)
    )
