"""URL filter: rules first, and boosted trees on lexical features where no rule speaks.

Everything here is DataFrame and SQL functions; training is Spark's own gradient-boosted trees, and
the fitted trees are turned into one SQL expression, so scoring is a narrow projection.

Rules are ``host/path`` strings. A rule fits its host and all subdomains if the path of the url
starts with the rule's path; of several, the longest wins (then the alphabetically first).

The trees learn from labelled urls (``url``, ``label`` 1 = block), which the caller passes. No table of
this repository's data labels urls, so the default is ``seed_urls``: 2,000 generated urls of plain and
of spam-like hosts, of words and shapes of their own and not after the tables. Kinds overlap on purpose:
hyphens, digits, suffixes, depth and parameters are in both, some clean hosts hold a spam word and some
spam hosts none, so no feature alone parts them. Half of the labels are 1, which urls in the wild are not: scores are turned to
an expected share of ``SHARE``. ``held_out`` counts the trees' verdicts on other such urls. Urls that a rule decides are no good labels: rules go by path and country, not by
the look of a url.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged
by its features like any other; an empty table gives an empty result; without labelled urls of both
kinds nothing is blocked by the trees; clashing extra columns are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Workspace, table

#: The rules that the query's contract fixes.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

#: Words of the generated labelled urls, by subject: medicines, gambling, credit, adult, copies, get-rich.
SPAM_WORDS = [
    "viagra", "cialis", "pharma", "steroid", "poker", "slots", "jackpot", "roulette", "payday", "loan", "lender", "debt", "xxx", "hookup", "escort",
    "webcam", "replica", "discount", "outlet", "knockoff", "crypto", "profit", "miracle", "slimming",
]
PLAIN_WORDS = [
    "news", "wiki", "docs", "garden", "music", "school", "river", "paper", "cook", "travel", "stone", "light", "museum", "library", "bridge",
    "weather", "chess", "bakery", "history", "physics", "bicycle", "forest", "harbor", "theatre",
]
#: Names without meaning are put together from these letters, by how common they are.
LETTERS = "eeeeeettttaaaaooooiiinnnssshhrrddllcumwfgypbvkxjqz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if null or without ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, lower).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):  # later ones win
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


#: Expected share of urls to block. Labels are half and half; odds are turned from that to this.
SHARE = 0.25

FEATURES = ["len", "host_len", "depth", "labels", "digits", "digit_ratio", "hyphens", "entropy", "params", "query_len", "fragment", "has_ext", "vowel_ratio", "suffix_rate", "gram_rate"]


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url``, ``host``, ``path``; null urls count as empty."""
    u = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    n = F.greatest(F.length(u), F.lit(1))
    host_n = F.greatest(F.length("host"), F.lit(1))
    alphabet = F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxyz0123456789-."))
    shares = F.transform(alphabet, lambda c: (F.length("host") - F.length(F.replace(F.col("host"), c, F.lit("")))) / host_n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, s: a + F.when(s > 0, -s * F.log2(s)).otherwise(0.0))
    # the host's letters before its suffix: words count alike with and without hyphens
    letters = F.regexp_replace(F.regexp_replace("host", r"\.[^.]*$", ""), "[^a-z]", "")
    cols = {
        "len": F.length(u),
        "host_len": F.length("host"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "labels": F.size(F.split("host", r"\.")),
        "digits": F.regexp_count(u, F.lit("[0-9]")),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n,
        "hyphens": F.regexp_count("host", F.lit("-")),
        "entropy": entropy,
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_len": F.length(query),
        "fragment": F.contains(u, F.lit("#")).cast("int"),
        "has_ext": F.col("path").rlike(r"\.[a-z]{2,5}$").cast("int"),
        "vowel_ratio": F.regexp_count("host", F.lit("[aeiou]")) / host_n,
        "suffix": F.substring_index("host", ".", -1),
        "grams": F.transform(F.sequence(F.lit(1), F.greatest(F.length(letters) - 3, F.lit(1))), lambda i: F.substring(letters, i, F.lit(4))),
    }
    return df.withColumns({k: v if k in ("suffix", "grams") else v.cast("double") for k, v in cols.items()})


def seed_urls(spark: SparkSession, n: int = 2000, start: int = 0) -> DataFrame:
    """Generated labelled urls ``url``, ``label``, ``kind`` (words of the host): ``n`` of them from number ``start``.

    Spam hosts hold two spam words, one, or none but a messy shape (digits, long parameters); clean hosts hold plain words or names,
    a tenth of them with a spam word and a tidy shape. The rest is drawn alike or with overlapping odds.
    """
    pick = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    of = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (pick(k, len(words)) + 1).cast("int"))
    bad, part = F.col("id") % 2 == 1, pick(1, 10)
    kind = F.when(bad, F.when(part < 3, "two spam words").when(part < 8, "one spam word").otherwise("plain words")).otherwise(F.when(part < 9, "plain words").otherwise("one spam word"))
    messy, tidy = bad & (kind == "plain words"), ~bad & (kind == "one spam word")
    # half of the plain words are invented names of 3 to 9 letters, in whatever order these fall
    letters = F.split(F.lit(LETTERS), "")
    name = lambda k: F.array_join(F.transform(F.sequence(F.lit(0), pick(k + 100, 7) + 2), lambda i: F.get(letters, F.pmod(F.xxhash64("id", F.lit(k + 110), i), F.lit(len(LETTERS))).cast("int"))), "")
    plain = lambda k: F.when(pick(k + 90, 2) == 0, of(PLAIN_WORDS, k)).otherwise(name(k))
    odds = lambda k, spam, clean: pick(k, 100) < F.when(messy, 95).when(tidy, 5).when(bad, spam).otherwise(clean)

    first = F.when(kind == "plain words", plain(2)).otherwise(of(SPAM_WORDS, 3))
    second = F.when(kind == "two spam words", of(SPAM_WORDS, 4)).otherwise(plain(5))
    swap = pick(6, 2) == 0
    joint = F.when(pick(7, 2) == 0, "-").otherwise("")
    label = F.concat(F.when(swap, second).otherwise(first), joint, F.when(swap, first).otherwise(second), F.when(odds(8, 45, 20), pick(9, 9999).cast("string")).otherwise(""))
    sub = of(["", "", "www.", "en.", "static.", "shop.city."], 10)
    suffix = F.when(odds(11, 50, 15), of(["info", "biz", "xyz", "top", "com"], 12)).otherwise(of(["com", "org", "net", "de", "edu", "info"], 13))
    step = lambda k: F.when(odds(k, 40, 30), F.concat(F.lit("/"), pick(k + 1, 999999).cast("string"))).otherwise(F.concat(F.lit("/"), of(PLAIN_WORDS, k + 1)))
    path = F.concat(*[F.when(pick(20, 5) > d, step(30 + 2 * d)).otherwise("") for d in range(4)], F.when(pick(20, 5) > 0, of(["", "", "/", ".html", ".php"], 21)).otherwise("/"))
    param = lambda k: F.concat(of(["id", "q", "sort", "from", "sid", "lang"], k), F.lit("="), F.when(odds(k + 1, 50, 30), F.hex(pick(k + 2, 1 << 40))).otherwise(of(PLAIN_WORDS, k + 2)))
    params = F.when(odds(40, 50, 35), F.concat(F.lit("?"), param(50), F.when(odds(41, 50, 30), F.concat(F.lit("&"), param(60), F.lit("&"), param(70))).otherwise(""))).otherwise("")
    scheme, mark = of(["http://", "https://"], 80), of(["", "", "", "", "#part"], 81)
    url = F.concat(scheme, sub, label, F.lit("."), suffix, path, params, mark)
    return spark.range(start, start + n).select(url.alias("url"), bad.cast("int").alias("label"), kind.alias("kind"))


def held_out(spark: SparkSession, n: int = 2000) -> DataFrame:
    """label, kind, hyphen, n, right: verdicts of the default trees on the ``n`` generated urls after the training ones, whose hosts training has not seen."""
    host = url_parts(F.col("url"))[0]
    rest = seed_urls(spark, n, 2000).withColumn("host", host)
    rest = rest.join(seed_urls(spark).select(host.alias("host")).distinct(), "host", "left_anti")
    got = filter_urls(rest, {}, id_col="url").select(F.col("page_id").alias("url"), "verdict").distinct()
    right = (F.col("verdict") == "block") == (F.col("label") == 1)
    counts = rest.join(got, "url").groupBy("label", "kind", F.contains("host", F.lit("-")).alias("hyphen"))
    return counts.agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right")).orderBy("label", "kind", "hyphen")


def _tree_sql(node, names: list[str]) -> str:
    if node.numDescendants() == 0:
        return repr(float(node.prediction()))
    split = node.split()
    name = names[split.featureIndex()]
    return f"CASE WHEN {name} <= {float(split.threshold())!r}D THEN {_tree_sql(node.leftChild(), names)} ELSE {_tree_sql(node.rightChild(), names)} END"


def _rates(labelled: DataFrame) -> list[tuple[str, dict[str, float], float]]:
    """Smoothed share of blocked labels of each suffix and each four letters of hosts, and the share that stands for the others; bounded by the labelled sample."""
    mean = labelled.agg(F.avg("label")).first()[0] or 0.0
    out = []
    for key, col, least, most in (("suffix", F.col("suffix"), 1, 200), ("gram", F.explode("grams"), 3, 400)):
        rows = labelled.select("label", col.alias("k")).groupBy("k").agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n"))
        top = rows.where(F.col("n") >= least).orderBy(F.desc("n"), "k").limit(most).collect()
        rest = mean
        if key == "gram":  # unknown letters are like rare ones
            few = rows.where(F.col("n") < least).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
            rest = ((few["s"] or 0) + 5 * mean) / ((few["n"] or 0) + 5)
        out.append((key, {r["k"]: (r["s"] + 5 * mean) / (r["n"] + 5) for r in top}, rest))
    return out


def _with_rates(df: DataFrame, rates) -> DataFrame:
    for key, known, rest in rates:
        rate = F.lit(float(rest))
        if known:
            m = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
            of = lambda x: F.coalesce(F.try_element_at(m, x), F.lit(float(rest)))  # noqa: B023, E731
            rate = of(F.col(key)) if key == "suffix" else F.aggregate("grams", F.lit(0.0), lambda a, g: a + of(g)) / F.size("grams")
        df = df.withColumn(f"{key}_rate", rate)
    return df


def train(labelled: DataFrame, ws: Workspace, trees: int = 12, depth: int = 4):
    """Fits the trees; returns (rates, SQL of the margin, share of label 1) or None if a kind of label is missing."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    host, path = url_parts(F.col("url"))
    rows = ws.write(lexical(labelled.withColumns({"host": host, "path": path})).coalesce(2), "labelled")
    if rows.select("label").distinct().count() < 2:
        return None
    rates = _rates(rows)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_with_rates(rows, rates)).select("label", "features")
    data = data.withColumn("label", F.col("label").cast("double"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxMemoryInMB=64).fit(data)
    sql = " + ".join(
        f"{float(w)!r}D * ({_tree_sql(t._call_java('rootNode'), FEATURES)})" for t, w in zip(model.trees, model.treeWeights)
    )
    return rates, sql, rows.agg(F.avg("label")).first()[0]


def filter_urls(
    pages: DataFrame, rules: dict[str, str] | None = None, labelled: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", share: float = SHARE,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the trees' share for block).

    ``share`` is the share of urls to block that is expected where the verdicts are given.
    """
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    ws = Workspace(spark, "urls")
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = url_parts(F.col("url"))
    fitted = train(labelled if labelled is not None else seed_urls(spark), ws)
    # the parts are computed once and read by rules and features alike
    parts = src.withColumns({"host": host, "path": path})
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if fitted:
        prior = math.log(share / (1 - share)) - math.log(fitted[2] / (1 - fitted[2]))
        scored = _with_rates(lexical(parts), fitted[0]).withColumn("score", 1 / (1 + F.exp(-2 * F.expr(fitted[1]) - F.lit(prior))))
    else:
        scored = parts.withColumn("score", F.lit(0.0))
    verdict = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    for rule, what in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
