import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import html_extract, packing, quality, toxicity, url_filter
from gleaner.llm.embedding_dedup import _tile, near_vectors


def test_packing_plan_places_every_rank_once():
    rng = np.random.default_rng(1)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 60), rng.integers(1, 40, 60))}
    used, ranks = {}, {}
    for length, rank, n, seq, offset in packing.plan_slots(counts, 100):
        for k in range(n):
            ranks.setdefault(length, []).append(rank + k)
            used.setdefault(seq + k, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert len(used) <= 1.05 * sum(k * n for k, n in counts.items()) / 100 + 1


def test_packing_rows(spark):
    texts = ["Hello World", None, "", "it's 42 ÄÖ", "word " * 5000, "a\x01b <|endoftext|>", "Hello World"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    lib = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack(df, keep_ids=True).collect()
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum((r["ids"] for r in own), []) == ids
        assert all(r["start"] == 2048 * k and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for k, r in enumerate(own))
    assert packing.pack(df.where("false")).count() == 0


def test_html():
    page = (
        "<html><body><nav><a href=1>Home</a></nav><div class=ad>Buy</div><article><h1>A &amp; B</h1><p>One  two <b>three</b> four five.<p>Six seven &#233; eight."
        "<script>x()</script><aside>not this</aside></article><div id=comments><p>Nice post, friend, thanks a lot</p></div><footer>(c)</footer></body></html>"
    )
    w = html_extract.weights_of(html_extract.fit_counts(page))
    assert html_extract.extract(page, w) == "A & B\n\nOne two three four five.\n\nSix seven é eight."
    assert html_extract.extract(None, w) == html_extract.extract("", w) == html_extract.extract("<p>", {}) == ""
    assert html_extract.extract("plain text only < 3", {}) == "plain text only < 3"
    assert html_extract.extract("<p>" + "word " * 200000, w).count("word") == 200000


def test_html_region_is_the_scans():
    body = "One two three four five six seven.", "Eight nine ten eleven twelve thirteen."
    teaser = "<div class=related><article><h2>Other story</h2><p>Read this one too, it is good.</p></article></div>"
    comment = "<aside class=comments><article><p>Nice post, friend, thanks a lot.</p></article></aside>"
    taught = html_extract.weights_of(html_extract.fit_counts(f"<body><nav>Menu</nav><div>Top</div><article><h1>Title here</h1><p>{body[0]}</p></article></body>"))
    for w in ({}, taught):
        for between in ("", teaser, comment, teaser + comment):
            page = f"<body><nav>Menu</nav><div><p>{body[0]}</p>{between}<p>{body[1]}</p></div><footer>End</footer></body>"
            assert html_extract.extract(page, w) == "\n\n".join(body)
    assert not html_extract.fit_counts(f"<body><p>{body[0]}</p>{teaser}</body>")


def test_html_names_are_evidence():
    body = "One two three four five six seven.", "Eight nine ten eleven twelve thirteen."
    paras = "".join(f"<p>{p}</p>" for p in body)
    main = f"<body><main><article>{paras}</article><div><a href=1>Other story</a><a href=2>Yet another one</a></div></main><footer>End</footer></body>"
    assert html_extract.extract(main, {}) == "\n\n".join(body)  # teasers of the same main are no part of it
    for mark in ('class="post search-results"', 'id="share-price-report"'):
        assert html_extract.extract(f"<body><nav><a href=1>Home</a></nav><div {mark}>{paras}</div><footer>End</footer></body>", {}) == "\n\n".join(body)
    ad = "<div class=promo-box>Buy this now, friends</div>"
    assert html_extract.extract(f"<body><div><p>{body[0]}</p>{ad}<p>{body[1]}</p></div></body>", {}) == "\n\n".join(body)
    taught = html_extract.weights_of(html_extract.fit_counts(f"<body><div class=zork>{'Outside words here. ' * 60}</div><article>{paras * 5}</article></body>"))
    assert taught["name:zork"] <= html_extract._CUT
    assert html_extract.extract(f"<body><div><p>{body[0]}</p><div class=zork>Some text here</div><p>{body[1]}</p></div></body>", taught) == "\n\n".join(body)


def test_html_words_outvote_names_and_tags():
    """An article in a box of any name, or a page within a form: the same text as without; readers' comments stay out."""
    import random

    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["one", "two", "three", "oak", "desk", "river"]) for _ in range(n)) + "."
    pages = []
    for _ in range(40):
        body = "".join(f"<p>{say(rng.randint(8, 60))}</p>" for _ in range(rng.randint(2, 6)))
        pages.append(f'<html><body><nav><ul><li><a href="/a">{say(2)}</a></li></ul></nav><div class="ad">{say(8)}</div><article><h1>{say(6)}</h1>{body}<aside>{say(4)}</aside></article><footer>{say(7)}</footer></body></html>')
    counts = html_extract.Counter()
    for p in pages[:10]:
        counts.update(html_extract.fit_counts(p))
    w = html_extract.weights_of(counts)
    for p in pages:
        want = html_extract.extract(p, w)
        assert want.count("\n\n") >= 2
        for box in ('<div class="share-report">', '<section id="search-results">', '<div class="news-widget">', '<div class="content">', '<div class="sidebar"><div class="promo">'):
            close = "".join(f"</{t}>" for t in ("div", "div") if "promo" in box) or ("</section>" if "section" in box else "</div>")
            assert html_extract.extract(p.replace("<article>", box).replace("</article>", close), w) == want
        for tag in ("form", "fieldset", "label", "dialog"):
            assert html_extract.extract(p.replace("<body>", f"<body><{tag}>").replace("</body>", f"</{tag}></body>"), w) == want
        talk = f'<div class="comments">{"<p>Nice post, friend, thanks a lot for it all.</p>" * 60}</div>'
        assert html_extract.extract(p.replace("<footer>", talk + "<footer>"), w) == want


def test_html_deep_nesting_is_linear():
    import time

    began = time.perf_counter()
    assert html_extract.extract("<p>" + "<b>x " * 100_000, {}).count("x") == 100_000
    assert html_extract.extract("<div>" * 50_000 + "word here" + "</i>" * 50_000, {}) == "word here"
    for page in ("<b><div>" + "<i>" * 100_000 + "</b>" * 100_000 + "word", "<p><div>" + "<i>" * 50_000 + "<li>x" * 50_000, "<form>" * 50_000 + "word here" + "</form>" * 50_000):
        html_extract.extract(page, {})
    assert time.perf_counter() - began < 40


def test_html_held_out_pages():
    """Articles of pages whose article element is renamed, so that nothing marks them."""
    import random

    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n)).capitalize() + "."

    def page(tag):
        paras = [words(rng.randrange(5, 60)) for _ in range(rng.randrange(1, 9))]
        nav = "".join(f"<li><a href=/{k}>{words(1)}</a></li>" for k in range(6))
        side = f"<div class=sidebar><ul><li><a href=/s>{words(4)}</a></li></ul></div>" if rng.random() < 0.5 else ""
        return f"<body><nav><ul>{nav}</ul></nav><div class=ad>{words(9)}</div><{tag}><h1>{words(4)}</h1>{''.join(f'<p>{p}</p>' for p in paras)}</{tag}>{side}<footer>{words(12)}</footer></body>", paras

    total = sum((html_extract.fit_counts(page("article")[0]) for _ in range(60)), html_extract.Counter())
    w, hit, got, want = html_extract.weights_of(total), 0, 0, 0
    for _ in range(60):
        html, paras = page("div")
        out = html_extract.extract(html, w).split()
        true = " ".join(paras).split()
        hit, got, want = hit + min(len(out), len(true)), got + len(out), want + len(true)
        assert all(p in html_extract.extract(html, w) for p in paras)
    assert 2 * hit / (got + want) > 0.95


@pytest.mark.parametrize(
    "url,host,path,rule",
    [
        (None, "", "", None), ("no scheme", "", "", None), ("https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/"),
        ("https://example.org/en/123", "example.org", "/en/123", "example.org/en/1"), ("https://example.org/en/2", "example.org", "/en/2", "org/"),
        ("http://x.com/de/1", "x.com", "/de/1", "com/de/"), ("http://x.com?a=/fr/", "x.com", "", None), ("http://notexample.org", "notexample.org", "", None),
    ],
)
def test_url_rules(spark, url, host, path, rule):
    h, p = url_filter.url_parts(F.col("url"))
    df = spark.createDataFrame([(url,)], "url string").withColumns({"h": h, "p": p})
    assert tuple(df.select("h", "p", url_filter.rule_of(F.col("h"), F.col("p"), url_filter.RULES)).first()) == (host, path, rule)


def test_url_verdicts(spark):
    df = spark.createDataFrame([(1, "https://viagra-poker77.example.com/en/1", "x"), (2, "https://wikinews.example.net/en/7", "x"), (3, None, "x")], "page_id long, url string, host string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df).collect()}
    assert got[1] == "block" and got[2] == "allow" and len(got) == 3


def test_url_labels_need_more_than_one_feature(spark):
    host, path = url_filter.url_parts(F.col("url"))
    rows = url_filter.lexical(url_filter.seed_urls(spark).withColumns({"host": host, "path": path}))
    plain = [f for f in url_filter.FEATURES if not f.endswith("_rate")]
    data = rows.select("label", *plain).toPandas()
    y = data["label"].to_numpy()
    for f in plain:
        x = data[f].to_numpy()
        right = max(max(np.mean((x > c) == y), np.mean((x <= c) == y)) for c in np.unique(x))
        assert right < 0.8, f
    kinds = {(r["label"], r["hyphen"]): r["share"] for r in url_filter.held_out(spark, 1000).groupBy("label", "hyphen").agg((F.sum("right") / F.sum("n")).alias("share")).collect()}
    assert len(kinds) == 4 and min(kinds.values()) > 0.85  # hyphens or not, spam or clean


def test_nnpu_learns_whatever_the_partitions(spark):
    g = np.random.default_rng(0)
    bad = [k % 5 == 0 for k in range(600)]
    text = lambda k: " ".join([f"w{i}" for i in g.integers(0, 500, 40)] + ([f"t{i}" for i in g.integers(0, 10, 3)] if bad[k] else []))
    docs = spark.createDataFrame([(k, text(k)) for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(bad[k])) for k in range(600)], "doc_id long, toxic int")
    one = {r["doc_id"]: r for r in toxicity.toxicity(docs.repartition(7), labels).collect()}
    test = [r for r in one.values() if r["held_out"]]
    assert np.mean([r["score"] > 0.5 for r in test if bad[r["doc_id"]]]) > 0.9 and np.mean([r["score"] < 0.5 for r in test if not bad[r["doc_id"]]]) > 0.9
    two = {r["doc_id"]: r for r in toxicity.toxicity(docs.repartition(3, "text"), labels).collect()}
    assert one == two
    rows = spark.createDataFrame([(None, " ".join(f"t{i}" for i in range(10))), (4, " ".join(f"t{i}" for i in range(10))), (5, "w1 w2 w3")], docs.schema)
    kept = {tuple(r) for r in toxicity.drop_toxic(docs.unionByName(rows), labels).collect()}
    assert not {tuple(r) for r in rows.collect()[:2]} & kept and (5, "w1 w2 w3") in kept  # each row by its own text
    many = spark.createDataFrame([(k, int(k % 2)) for k in range(600)], "doc_id long, quality int")
    one, two = ({r["doc_id"]: r["score"] for r in quality.score(d, many, max_docs=40, max_bytes=6400).collect()} for d in (docs.repartition(7), docs.repartition(2, "text")))
    assert all(abs(one[k] - two[k]) < 1e-5 for k in one)  # the same model; batches round sums differently


def test_scores_are_defined_everywhere(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["a b", None, "", "idiot " * 3, "x" * 200000])], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for out in (toxicity.toxicity(docs, labels), quality.quality(docs, labels), toxicity.toxicity(docs, labels.where("false")), quality.quality(docs, labels.where("false"))):
        rows = out.collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)


def test_cnn_learns_and_parts_agree():
    g = np.random.default_rng(3)
    good = [bytes(g.integers(97, 122, 300, dtype=np.uint8)) for _ in range(40)]
    bad = [bytes(g.integers(33, 47, 300, dtype=np.uint8)) for _ in range(40)]
    m = quality.fit(good + bad, np.array([1.0] * 40 + [0.0] * 40), epochs=4)
    p = quality.predict(m, good + bad + [b""])
    assert p[:40].min() > p[40:80].max()
    long = b"".join(good) * 20
    assert abs(quality.predict(m, [long])[0] - quality._long(m, long, quality.HOP * 7)) < 1e-5


def brute_vectors(x, cosine=0.95):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= cosine
    label, was = np.arange(len(x)), None
    while was is None or (was != label).any():
        was = label
        label = np.array([label[np.flatnonzero(r)].min() for r in near])
        label = label[label]
    return near.sum(1) - 1, label


@pytest.mark.parametrize("block_bytes", [640, 6400, 8 << 20])
def test_vectors(spark, block_bytes):
    g = np.random.default_rng(2)
    x = g.normal(size=(400, 8))
    x[10:60] = x[0] + g.normal(size=(50, 8)) * 0.05  # a crowd
    x[60] = x[0]
    plane = np.deg2rad(15 * g.permutation(120))[:, None]  # a chain round a plane, ids in no order
    x[100:220] = np.cos(plane) * np.eye(8)[0] + np.sin(plane) * np.eye(8)[1] + np.arange(120)[:, None] * 1e-9
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (401, [], 0), (402, [0.0] * 8, 0), (403, [float("nan")] * 8, 0), (404, [1.0, None], 0)]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int"), block_bytes=block_bytes).collect()}
    n, label = brute_vectors(x)
    assert {i: (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(400)} == {i: (n[i], label[i], label[i] == i) for i in range(400)}
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(400, 405))


def test_vectors_of_many_lengths_and_none(spark):
    df = spark.createDataFrame([(i, [1.0] * (1 + i // 2)) for i in range(2100)] + [(0, [1.0]), (None, [1.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in near_vectors(df, block_bytes=80_000).collect()}
    assert all(got[i]["component_id"] == i - i % 2 and got[i]["n_links"] == (2 if i < 2 else 1) for i in range(2100)) and got[None]["n_links"] == 0
    assert near_vectors(df.where("false")).count() == 0


def test_long_chain_is_one_component():
    n = 1000
    x = (np.eye(n, n + 1) + np.eye(n, n + 1, 1)) / np.sqrt(2)  # neighbours have cosine 0.5, others 0
    ids = [2 * min(k, n - 1 - k) + (k >= n // 2) for k in range(n)]  # two basins, which meet in the middle
    t = pa.table({"v": pa.array(ids, pa.int64()), "weight": pa.array([1] * n, pa.int64()), "u": [v.tobytes() for v in x]})
    out = _tile(0.45, 0.4499)((pa.scalar(0), pa.scalar(0), pa.scalar(0)), t, t)
    assert set(out.column("label").to_pylist()) == {0} and set(out.column("v").to_pylist()) == set(ids)
