"""Personal data in texts: exact base patterns, and further spans by weakly supervised labelers.

Base spans are what fixed patterns find (mail and network addresses, payment cards with a right check sum, international phone numbers); they always stay.
Looser forms (mail addresses spelled out, national phone numbers, cards with other separators, IPv6) are candidates. Four
labelers vote for, against or not at all on each candidate: a pattern of strict forms, a gazetteer (top-level domains, country and area codes,
card issuers, address ranges), the words around it, and its shape. No votes are right by themselves: per kind, expectation
maximisation estimates how reliable each labeler is and how likely each combination of votes marks personal data. Base spans, and matches of base patterns
that fail their checks, are anchors with known labels. The posteriors are soft labels on which the final span
classifier (a logistic regression over features of span and context) is trained; it decides which candidates join.

In Spark: one narrow pass reads the texts and writes a small row a document (its spans and candidates, with votes and features as two numbers);
the counts of distinct (kind, votes, features) over all documents, of which there are at most 4 x 81 x 2,048 whatever the corpus, are all
that reaches the driver; scoring is a native expression over the small rows. No text is shuffled, and nothing is sampled.

Defined cases: null and empty texts have no spans; equal rows get equal spans; offsets are code points; a null id stays null; extra columns are
ignored; an empty table gives an empty result; long runs of digits, dots or letters are read in linear time. Of overlapping
candidates of a kind the one that starts first, then the longer one counts, and none that overlaps a match of a base pattern (mail addresses may hold a base one). Without
candidates nothing is trained and the base spans are the result.
"""

from __future__ import annotations

import ipaddress
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Workspace, chunked, ship, table

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Base patterns, in forms that read any text in linear time
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return _NO_DIGIT.sub("", text)


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end, True
            at = text.find("@", end)
        else:
            end, at = at + 1, text.find("@", at + 1)


def _ips(text: str):
    """Four numbers at a time of each dotted chain of numbers."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            at, numbers = m.start(), m.group().split(".")
            for k in range(0, len(numbers) - 3, 4):
                four = numbers[k : k + 4]
                end = at + sum(map(len, four)) + 3
                yield at, end, all(len(x) <= 3 and int(x) <= 255 for x in (x.lstrip("0") or "0" for x in four))
                at = end + 1


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19:
                yield m.start(), m.end(), luhn(d)


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            yield m.start(), m.end(), True


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, whether it holds) of all matches of the base patterns; those that hold are base spans."""
    found = []
    for kind, find in enumerate((_emails, _ips, _cards, _phones)):
        found += [(a, b, kind, ok) for a, b, ok in find(text)]
    return found


# Candidates: looser forms
_AT = re.compile(r"[\[({<]\s?(?:at|AT|At|@)\s?[\])}>]|\s(?:at|AT)\s|\s@\s?|@\s")
_BEFORE_AT = re.compile(r"(?:[A-Za-z0-9_%+-]{1,32}\s(?:dot|DOT)\s){0,3}[A-Za-z0-9._%+-]{1,64}\s{0,2}\Z")
_AFTER_AT = re.compile(
    r"\s{0,2}[A-Za-z0-9-]{1,63}(?:(?:\s{0,2}[\[({<]\s?(?:dot|DOT|Dot|\.)\s?[\])}>]\s{0,2}|\s{1,2}(?:dot|DOT)\s{1,2}|\.)[A-Za-z0-9-]{1,63}){1,5}"
)
_WIDE_EMAIL = re.compile(r"[^\W_](?:[\w.%+-]{0,63})@[\w-]{1,63}(?:\.[\w-]{1,63}){1,6}")
_CHAIN = re.compile(r"\+?[0-9(][0-9()\x20\t.\-/\u00a0\u2009\u2010-\u2013]{5,40}[0-9]")
_COLONS = re.compile(r"[0-9A-Fa-f:]*:[0-9A-Fa-f:]+")

# Gazetteers
_TLDS = frozenset(["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "me", "dev", "app", "de", "fr", "es", "it", "uk", "us", "ca", "mx", "nl", "be", "ch", "at", "eu", "pt", "pl", "se", "no", "dk", "fi", "ie", "jp", "cn", "in", "br", "ar", "cl", "au", "nz", "za", "kr", "ru"])
_COUNTRIES = frozenset(["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "353", "358", "420"])
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[068]|6[0-9]|35")
_CUES = {
    EMAIL: re.compile(r"\b(?:e-?mails?|mails?|contact\w*|write|reach|correo|courriel|kontakt|adresse?)\b", re.I),
    IP: re.compile(r"\b(?:ip|ipv6|address|addr|server|host|subnet|ping|client|login|from)\b", re.I),
    CARD: re.compile(r"\b(?:cards?|visa|mastercard|amex|credit|debit|cvv|cvc|expir\w*|exp|tarjeta|carte|karte|kreditkarte|pago)\b", re.I),
    PHONE: re.compile(r"\b(?:phones?|call|tel|telephone|tel[eé]fono|t[eé]l[eé]phone|telefon|mobile|cell|fax|text|sms|whatsapp|dial|ring|contact|handy|m[oó]vil)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:version|isbn|issn|order|invoice|serial|part|sku|model|ticket|section|chapter|page|pages|build|release|vol|tracking|id|ref|reference|no|art|figure|table|lines?)\b[\s.:#-]*$", re.I)
_NANP = re.compile(r"(?:1[\x20.-]?)?(?:\([2-9][0-9]{2}\)[\x20.-]?|[2-9][0-9]{2}[\x20.\u00a0\u2010-\u2013-])[2-9][0-9]{2}[\x20.\u00a0\u2010-\u2013-][0-9]{4}")
_TRUNK = re.compile(r"(?:00[1-9]|0[1-9])[0-9]*[\x20./\u2010-\u2013-](?:[0-9]{2,}+[\x20./\u2010-\u2013-]?)+")
_DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})(?![0-9])")

#: Features of a span, one bit each, with what the classifier expects of them before it has seen anything.
FEATURES = (
    ("strict", 1.5), ("listed", 1.0), ("cue", 1.5), ("against", -2.5), ("embedded", -3.0), ("dull", -2.5), ("separated", 0.3), ("bracketed", 0.3),
    ("usual length", 0.4), ("own line", 0.2), ("unlisted", -1.0),
)
BIAS = -2.2
#: Votes of a labeler: 0 none, 1 for, 2 against. Chances of each, for personal data and for other spans, before any corpus was seen.
LABELERS = ("pattern", "gazetteer", "context", "shape")
_EXPECTED = np.array([[[0.30, 0.65, 0.05], [0.30, 0.65, 0.05], [0.60, 0.37, 0.03], [0.25, 0.72, 0.03]], [[0.50, 0.15, 0.35], [0.45, 0.20, 0.35], [0.65, 0.05, 0.30], [0.30, 0.25, 0.45]]])


def describe(text: str, a: int, b: int, kind: int) -> tuple[int, int]:
    """Votes (base three, a digit a labeler) and features (bits) of a span."""
    span, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 24]
    d = _digits(span)
    cue = bool(_CUES[kind].search(before) or _CUES[kind].search(after))
    against = bool(_AGAINST.search(before)) and not cue
    left, right = text[a - 1 : a], text[b : b + 1]
    embedded = (left.isalnum() or left in tuple("_/#@=&-.") and left != "") or (right.isalnum() or right in tuple("_/@#=&") and right != "")
    dull = kind != EMAIL and kind != IP and len(set(d)) <= 2
    strict = listed = unlisted = odd = False
    if kind == EMAIL:
        tld = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]}> "))[-1].lower()
        strict = "@" in span or bool(re.search(r"[\[({<]|(?i:\sdot\s)", span))
        listed, odd, usual = tld in _TLDS, not tld.isalpha(), 6 <= b - a <= 60
        unlisted = not listed
    elif kind == IP:
        try:
            ip = ipaddress.IPv6Address(span)
            strict, listed = True, ip.is_global or ip.is_private
        except ValueError:
            odd = True
        usual = b - a >= 8
    elif kind == CARD:
        listed, strict = bool(_ISSUERS.match(d)), len({len(x) for x in re.split(r"[^0-9]+", span)}) <= 2
        unlisted, odd, usual = not listed, not luhn(d), len(d) in (15, 16)
    else:
        national = d[1:] if len(d) == 11 and d[0] == "1" else d
        strict = bool(_NANP.fullmatch(span)) or bool(_TRUNK.fullmatch(span))
        code = d[2:] if d[:2] == "00" else d if "+" in span else ""
        listed = any(code.startswith(c) for c in _COUNTRIES) if code else len(national) == 10 and national[0] in "23456789" and national[3] in "23456789" and national[1:3] != "11"
        unlisted, odd, usual = len(national) == 10 and not listed and not code and national[0] != "0", len(d) > 13, 10 <= len(d) <= 12
    votes = (1 if strict else 2 if odd else 0, 1 if listed else 2 if unlisted else 0, 1 if cue else 2 if against else 0, 2 if embedded or dull else 1 if usual else 0)
    line_start = before[-1:] in ("", "\n", ":", "|", ">")
    bits = (strict, listed, cue, against, embedded, dull, bool(_NO_DIGIT.search(span.strip("()"))), span[:1] == "(" or "[" in span, usual, line_start, unlisted)
    return sum(v * 3**k for k, v in enumerate(votes)), sum(int(x) << k for k, x in enumerate(bits))


def candidates(text: str, low: str, base: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of looser forms."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), EMAIL) for m in _WIDE_EMAIL.finditer(text) if not m.group().isascii()]
    if "@" in text or "dot" in low or re.search(r"[\[({<]\s?at\s?[\])}>]", low):
        for m in _AT.finditer(text):
            if after := _AFTER_AT.match(text, m.end()):
                before = _BEFORE_AT.search(text, max(0, m.start() - 120), m.start())
                if before and re.search(r"@|[\[({<]|\sdot\s", text[m.start() : after.end()], re.I):  # "look at example.com" is no address
                    found.append((before.start(), after.end(), EMAIL))
    if "::" in text or text.count(":") >= 7:
        for m in _COLONS.finditer(text):
            if m.end() - m.start() <= 45 and m.group().count(":") >= 2 and ("::" in m.group() or m.group().count(":") == 7):
                try:
                    ipaddress.IPv6Address(m.group())
                except ValueError:
                    continue
                if len(m.group()) > 4:
                    found.append((m.start(), m.end(), IP))
    for m in _CHAIN.finditer(text):
        n = len(_digits(m.group()))
        a, b = m.span()
        if _DATE.search(m.group()):
            continue
        if m.group()[0] == "(" and ")" not in m.group():
            a += 1
        if (p := _NANP.search(text, a, b)) and not text[p.start() - 1 : p.start()].isdigit() and not text[p.end() : p.end() + 1].isdigit():
            found.append((*p.span(), PHONE))
        elif 13 <= n <= 19 and luhn(_digits(m.group())):
            found.append((a, b, CARD))
        elif 9 <= n <= 15:
            found.append((a, b, PHONE))
    out, last = [], [0] * len(KINDS)
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if a < last[kind] or any(a < e and s < b and (k != kind or s <= a and b <= e or kind != EMAIL) for s, e, k, _ in base):
            continue
        out.append((a, b, kind))
        last[kind] = b
    return out


_SPAN = "array<struct<start:long,end:long,kind:int>>"
_SEEN = "array<struct<start:long,end:long,kind:int,votes:int,bits:int,anchor:int>>"
_FIELDS = pa.list_(pa.struct([(n, t) for n, t in (("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()))]))
_SEEN_FIELDS = pa.list_(pa.struct([(n, t) for n, t in (("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("votes", pa.int32()), ("bits", pa.int32()), ("anchor", pa.int32()))]))


def _read(batches):
    """Base spans and described candidates of each text; anchors are base matches (1 if they hold, 0 if not), candidates have none."""
    for b in chunked(batches, 128):
        spans, seen = [], []
        for text in b.column(1).to_pylist():
            if not text:
                spans.append([])
                seen.append([])
                continue
            base = base_matches(text)
            spans.append([(s, e, k) for s, e, k, ok in base if ok])
            rows = [(s, e, k, *describe(text, s, e, k), int(ok)) for s, e, k, ok in base]
            seen.append(rows + [(s, e, k, *describe(text, s, e, k), -1) for s, e, k in candidates(text, text.lower(), base)])
        yield pa.RecordBatch.from_arrays([b.column(0), _structs(spans, _FIELDS), _structs(seen, _SEEN_FIELDS)], names=["doc_id", "base", "seen"])


def _structs(rows: list[list[tuple]], kind: pa.ListType) -> pa.Array:
    names = [f.name for f in kind.value_type]
    return pa.array([[dict(zip(names, x)) for x in r] for r in rows], kind)


def posteriors(votes: np.ndarray, n: np.ndarray, anchor: np.ndarray, strength: float = 20.0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation maximisation for one kind: chance of personal data of each row of votes, reliabilities (class x labeler x vote), and their share.

    ``anchor`` is 1 or 0 where the label is known, -1 else; ``strength`` is how many spans of each class the expected reliabilities
    are worth. Anchors of a class weigh no more than all candidates together and never count for the share.
    """
    digits = votes[:, None] // 3 ** np.arange(len(LABELERS)) % 3
    free = anchor < 0
    w = n.astype(float)
    for c in (0, 1):
        known = anchor == c
        if known.any():
            w[known] *= min(1.0, max(n[free].sum(), 1) / n[known].sum())
    rel, share = _EXPECTED.copy(), 0.3
    post = np.where(anchor == 1, 1.0, 0.0)
    for _ in range(rounds):
        chance = [np.log(rel[y][np.arange(len(LABELERS)), digits]).sum(1) + math.log(share if y == 0 else 1 - share) for y in (0, 1)]
        new = np.where(free, 1 / (1 + np.exp(np.clip(chance[1] - chance[0], -500, 500))), post)
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        for y, p in ((0, post), (1, 1 - post)):
            for k in range(len(LABELERS)):
                counts = strength * _EXPECTED[y, k] + np.bincount(digits[:, k], w * p, 3)
                rel[y, k] = counts / counts.sum()
        share = float((strength * 0.3 + (n * post)[free].sum()) / (strength + n[free].sum()))
        if done:
            break
    return post, rel, share


def fit_classifier(bits: np.ndarray, w: np.ndarray, target: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; weights are drawn to their expected values."""
    x = np.hstack([np.ones((len(bits), 1)), (bits[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)])
    mean = np.array([BIAS, *[f[1] for f in FEATURES]])
    beta = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - target)) + ridge * (beta - mean)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(mean)), grad)
        beta -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(counts: dict[tuple[int, int, int, int], int]) -> dict[int, np.ndarray]:
    """Weights of the span classifier of each kind from counts of (kind, votes, bits, anchor)."""
    out = {}
    for kind in range(len(KINDS)):
        rows = sorted((k[1:], n) for k, n in counts.items() if k[0] == kind)
        if not any(k[2] < 0 for k, _ in rows):
            continue
        votes, bits, anchor = (np.array([k[i] for k, _ in rows]) for i in range(3))
        n = np.array([c for _, c in rows], float)
        post, _, _ = posteriors(votes, n, anchor)
        free = n[anchor < 0].sum()
        w = n.copy()
        for c in (0, 1):
            if (anchor == c).any():
                w[anchor == c] *= min(1.0, free / n[anchor == c].sum())
        # more than some thousand spans teach no more than that; so the expected weights keep a say where a feature is rare
        out[kind] = fit_classifier(bits, w * min(1.0, 5000 / w.sum()), post)
    return out


def _score(seen: Column, weights: dict[int, np.ndarray]) -> Column:
    def of(c: Column) -> Column:
        total = F.lit(None).cast("double")
        for kind, beta in weights.items():
            z = F.lit(float(beta[0]))
            for k, v in enumerate(beta[1:]):
                z = z + F.shiftright(c["bits"], k).bitwiseAND(1) * F.lit(float(v))
            total = F.when(c["kind"] == kind, 1 / (1 + F.exp(-z))).otherwise(total)
        return total

    return F.transform(
        F.filter(seen, lambda c: c["anchor"] < 0), lambda c: F.struct(c["start"], c["end"], c["kind"], of(c).alias("score"), F.lit(False).alias("base"))
    )


def find_pii(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array<struct<start, end, kind, score, base>> by start, then kind; offsets in code points, ends exclusive.

    Base spans have score 1; other spans are those that the classifier gives ``least`` or more.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "pii")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    read = ws.write(src.mapInArrow(_read, f"doc_id long, base {_SPAN}, seen {_SEEN}"), "read")
    counts = read.select(F.explode("seen").alias("s")).groupBy("s.kind", "s.votes", "s.bits", "s.anchor").agg(F.count(F.lit(1)).alias("n")).collect()
    weights = fit(Counter({(r["kind"], r["votes"], r["bits"], r["anchor"]): r["n"] for r in counts}))
    base = F.transform("base", lambda s: F.struct(s["start"], s["end"], s["kind"], F.lit(1.0).alias("score"), F.lit(True).alias("base")))
    added = F.filter(_score(F.col("seen"), weights), lambda s: s["score"] >= least) if weights else F.array().cast("array<struct<start:long,end:long,kind:int,score:double,base:boolean>>")
    order = F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"], s["kind"], s["end"], s["score"], s["base"])))
    names = F.array(*map(F.lit, KINDS))
    return read.select("doc_id", F.transform(order, lambda s: F.struct(s["start"], s["end"], F.get(names, s["kind"]).alias("kind"), s["score"], s["base"])).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], kept, F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))).otherwise(acc)

    folded = F.aggregate(spans, start, step)
    return F.concat(folded["out"], F.substring(text, (folded["at"] + 1).cast("int"), F.length(text)))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
