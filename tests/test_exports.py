"""Exports are valid as a whole or not at all; corpora raise; pages are read as the browser shows them."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import evaluate, image
from gleaner.operators import score as S
from gleaner.operators.flood import hamming
from gleaner.sources import exports, extract, files

MATCH = {"ruleId": "vendor-temu", "category": "known-vendor", "weight": 32, "reason": "source", "confidence": "high", "sample": "Temu"}
DEEP = dict.fromkeys(exports.DEEP_COUNTS, 3) | {"lastFailures": [{"itemId": "9", "kind": "network"}]}
GOOD = {
    "ok": True, "stats": {"scanned": 2, "hidden": 1, "dimmed": 0, "labeled": 0}, "showHidden": False,
    "decisions": [{"title": "Lamp", "priceText": "$12", "action": "hide", "score": 90.5, "visibleTextExcerpt": "a lamp", "matches": [MATCH], "idHint": "7", "url": "https://x.example/7"}, {"title": "", "priceText": "", "action": "allow", "score": 0, "visibleTextExcerpt": "", "matches": []}],
}


def changed(path, value):
    d = copy.deepcopy(GOOD) | {"deepScan": copy.deepcopy(DEEP)}
    at = d
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(d)


D, M = ("decisions", 0), ("decisions", 0, "matches", 0)
BAD = [
    (("ok",), False), (("ok",), "true"), (("ok",), 1), (("ok",), KeyError), (("showHidden",), KeyError), (("showHidden",), None), (("showHidden",), "no"), (("stats",), KeyError), (("stats", "hidden"), -1), (("stats", "hidden"), 1.5),
    (("stats", "hidden"), "1"), (("stats", "scanned"), KeyError), (("decisions",), KeyError), (("decisions",), {}), (("decisions",), "x"), (("decisions", 1), None), (("decisions", 1), 5), ((*D, "title"), 5), ((*D, "title"), None),
    ((*D, "priceText"), KeyError), ((*D, "visibleTextExcerpt"), True), ((*D, "score"), "90"), ((*D, "score"), KeyError), ((*D, "score"), 10**400), ((*D, "action"), "Hide"), ((*D, "action"), None), ((*D, "idHint"), 7), ((*D, "idHint"), None),
    ((*D, "url"), []), ((*D, "matches"), KeyError), ((*D, "matches"), {}), ((*M, "ruleId"), 1), ((*M, "reason"), None), ((*M, "reason"), KeyError), ((*M, "weight"), "32"), ((*M, "category"), "not-a-category"), ((*M, "category"), 3), ((*M, "confidence"), "sure"),
    ((*M, "sample"), None), ((*M, "sample"), 4), (M, "x"), (M, None),
]
FINE = [((*D, "score"), -3), ((*D, "score"), 1e300), ((*D, "idHint"), KeyError), ((*M, "sample"), KeyError), (("stats", "hidden"), 5.0), (("decisions",), []), (("extra",), {"a": 1}), ((*M, "weight"), -20.5)]
DEEP_BAD = [(("deepScan",), None), (("deepScan", "fetched"), -1), (("deepScan", "errors"), "0"), (("deepScan", "pending"), KeyError), (("deepScan", "lastFailures"), {}), (("deepScan", "lastFailures", 0), {"itemId": 9, "kind": "x"}), (("deepScan", "completed"), 0.5)]


def test_strict_exports(spark):
    docs = [(f"bad {p} {v!r}"[:60], changed(p, v)) for p, v in BAD] + [(f"fine {p} {v!r}", changed(p, v)) for p, v in FINE] + [(f"deep {p} {v!r}", changed(p, v)) for p, v in DEEP_BAD]
    docs += [("bad null", None), ("bad empty", ""), ("bad text", "{no json"), ("bad array", "[]"), ("bad number", "5"), ("bad null json", "null"), ("fine all", json.dumps(GOOD))]
    out = {r["name"]: r for r in exports.checked(spark.createDataFrame([(n, x) for n, x in docs], "name string, value string").repartition(3)).collect()}
    wrong = {n for n, r in out.items() if (r["problem"] is not None) != n.startswith("bad") or (r["report"] is None) != n.startswith("bad")}
    assert not wrong and len(out) == len(docs)
    assert all(r["report"]["deep_scan"] is None for n, r in out.items() if n.startswith("deep"))
    deep = next(r for n, r in out.items() if n.startswith("fine") and "extra" in n)["report"]["deep_scan"]
    assert deep["fetched"] == 3 and deep["lastFailures"][0]["kind"] == "network"
    rows = exports.decisions_of(exports.checked(spark.createDataFrame([(json.dumps(GOOD),), ("x",)], "value string"))).collect()
    assert [(r["title"], r["score"], r["item_id"], len(r["matches"])) for r in rows] == [("Lamp", 90.5, "7", 1), ("", 0.0, None, 0)]


def test_corpora_raise(spark, tmp_path):
    good = [{"id": "a", "title": "Lamp", "label": "legit", "price": "$5", "body": "one\ntwo", "location": "Bend, OR"}]
    (tmp_path / "x.json").write_text(json.dumps(good))
    rows = files.read_corpus(spark, str(tmp_path))
    seen = {r["view"]: r["text_lines"] for r in evaluate.views(rows).collect()}
    assert seen == {"card": ["$5", "Lamp", "Bend, OR"], "detail": ["$5", "Lamp", "Bend, OR", "one", "two"]}
    for bad in ({"id": "b", "title": "", "label": "slop"}, {"id": "b", "title": "x"}, {"title": "x", "label": "slop"}, {"id": "a", "title": "again", "label": "slop"}):
        (tmp_path / "y.json").write_text(json.dumps([bad]))
        with pytest.raises(ValueError):
            files.read_corpus(spark, str(tmp_path))


def test_page_lines(spark):
    pages = [
        "<p>one</p><noscript>junk<p>two</p>", "<p>a</p><noscript>no</noscript><template>t</template><script>x</script><p>b</p>", '<div class="card"><b class="x gleaner-badge">hidden<i>too</i></b><p>shown</p></div>',
        '<h1>Head</h1><a aria-label="link">1</a><img aria-label="pic"><b aria-label="View in 3D"></b>' + '<i aria-label="more"></i>' * 12,
    ]
    got = [r["parsed"] for r in extract.page_lines(spark.createDataFrame(list(enumerate(pages)), "n int, html string").coalesce(1)).orderBy("n").collect()]
    assert [r["lines"] for r in got] == [["one", "junk", "two"], ["a", "b"], ["shown"], ["Head", "1"]]
    assert got[3]["labels"] == ["View in 3D", *["more"] * 9] and got[3]["title"] == "Head"


def test_photos(spark):
    """Hashes of gradients, differences of hex strings, and the stock photo rule."""
    grid = lambda f: [v for y in range(8) for x in range(9) for v in (f(x, y), f(x, y), f(x, y), 255)]
    df = spark.createDataFrame([(grid(lambda x, y: x * 20),), (grid(lambda x, y: 200 - x * 20),), (grid(lambda x, y: 90),), (grid(lambda x, y: 20 * x if y == 3 else 0),)], "g array<int>").coalesce(1)
    a, b, c, d = (r[0] for r in df.select(image.dhash(F.col("g"))).collect())
    assert {a, b} == {"f" * 16, "0" * 16} and c == "0" * 16 and bin(int(d, 16)).count("1") == 8 or a == "0" * 16
    r = spark.range(1).select(hamming(F.lit("f" * 16), F.lit("0" * 16)).alias("x"), hamming(F.lit("8" + "0" * 15), F.lit("0" * 16)).alias("y"), hamming(F.lit("ff"), F.lit("f")).alias("z")).first()
    assert (r["x"], r["y"], r["z"]) == (64, 1, None)
    card = "'Chair' AS title, '$5' AS price_text, '' AS location_text, '' AS seller_text, 'chair' AS visible_text"
    got = S.score(spark.sql(f"SELECT {card}, true AS image_catalog_style UNION ALL SELECT {card}, false UNION ALL SELECT {card}, null")).select(F.transform("matches", lambda m: m["rule_id"]).alias("ids")).collect()
    assert sorted(len(r["ids"]) for r in got) == [0, 0, 1] and ["image-catalog-photo"] in [r["ids"] for r in got]
