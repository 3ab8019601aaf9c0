"""Cards and ad units of pages against a recursive search over the parsed tree."""

import random
import re
import xml.etree.ElementTree as ET

from gleaner.functions import text as T
from gleaner.operators import discover
from gleaner.sources import elements, extract
from pyspark.sql import functions as F

ITEM = ("/marketplace/item/", "/marketplace/shops/item/", "/marketplace/np/item/")


def is_item(e):
    return e.tag == "a" and any(x in e.get("href", "") for x in ITEM)


def is_ad(e):
    h = e.get("href", "")
    return e.tag == "a" and ("/ads/about" in h or "l.facebook.com/l.php" in h or h.startswith("https://l.facebook.com"))


def key(e):
    m = re.search(r"/marketplace/(?:shops/|np/)?item/([^/?#]+)", e.get("href"))
    return m.group(1) if m else e.get("href")


def under(e):
    return [x for x in e.iter() if x is not e]


def own(e, parents):
    while e is not None:
        if "gleaner-toolbar" in e.get("class", ""):
            return True
        e = parents.get(e)
    return False


def lines(e, parents):
    """Texts in document order, equal neighbours once, without the library's own elements."""
    out = []

    def add(text, holder):
        t = " ".join((text or "").split())
        if t and not own(holder, parents) and (not out or out[-1] != t):
            out.append(t)

    def walk(x):
        add(x.text, x)
        for c in x:
            walk(c)
            add(c.tail, x)

    walk(e)
    return out


def big(e):
    m = dict(re.findall(r"(width|height):(\d+)px", e.get("style", "")))
    return int(m.get("width", 90)) >= 90 and int(m.get("height", 70)) >= 70


def region(e):
    return e.tag == "main" or e.get("role") in ("main", "dialog") or any(x.tag == "h1" for x in under(e))


def marked(a, parents):
    while a is not None:
        if "data-gleaner" in a.attrib:
            return a
        a = parents.get(a)


def card_of(a, parents):
    if (m := marked(a, parents)) is not None:
        return m
    best, node = a, a
    for _ in range(9):
        if node is None or node.tag == "body" or region(node):
            break
        text, links = "".join(node.itertext()), [x for x in under(node) if is_item(x)]
        kinds = {key(x) for x in links}
        if links and len(kinds) == 1 and 8 <= len(text) <= 1400 and big(node):
            best = node
        if len(kinds) > 1 or len(links) > 3 or len(text) > 1600:
            break
        node = parents.get(node)
    return best


def cell_of(a, parents):
    if (m := marked(a, parents)) is not None:
        return m
    best, node = None, a
    for _ in range(9):
        if node is None or node.tag == "body" or region(node):
            break
        seen = lines(node, parents)
        text = " ".join("\n".join(seen).split())
        if len(text) > 1400 or any(is_item(x) for x in under(node)):
            break
        if any(x.lower() == "sponsored" for x in seen) and big(node) and len(text) >= 8:
            best = node
        node = parents.get(node)
    return best


def brute(page):
    root = ET.fromstring(page)
    order = {e: i for i, e in enumerate(root.iter())}
    parents = {c: p for p in root.iter() for c in p}
    found = {}
    for test, find, ad in ((is_item, card_of, False), (is_ad, cell_of, True)):
        taken = set(found)
        for a in [e for e in root.iter() if test(e)]:
            e = find(a, parents)
            if e is not None and order[e] not in found and order[e] not in taken and not own(e, parents):
                found[order[e]] = (ad, a.get("href"))
    return found


def random_page(rng):
    def link():
        n = rng.randint(1, 6)
        return rng.choice([f"/marketplace/item/{n}/", f"https://www.facebook.com/marketplace/item/{n}/?ref=x", f"/marketplace/np/item/{n}", "/marketplace/item/", "https://l.facebook.com/l.php?u=1", "/ads/about/?x", "/help", "https://l.facebook.com/z"])

    def tree(depth):
        tag = rng.choice(["div", "div", "div", "span", "section", "a", "a", "h2", "main"] if rng.random() < 0.93 else ["h1"])
        attrs = f' href="{link()}"' if tag == "a" else ""
        if rng.random() < 0.08:
            attrs += rng.choice([' role="main"', ' role="dialog"', ' role="list"', ' data-gleaner="hide"', ' class="x gleaner-toolbar"', ' style="width:50px;height:90px"', ' style="width:100px; height:20px"', ' aria-label="Some label"'])
        body = rng.choice(["", "", "Sponsored", "sponsored", "word " * rng.randint(1, 6), "Oak desk", "Oak desk", "long text " * rng.choice([5, 50, 160])])
        kids = "" if depth > 9 or rng.random() < 0.15 else "".join(tree(depth + 1) + rng.choice(["", "tail", "Sponsored", " "]) for _ in range(rng.choice([0, 1, 1, 1, 2, 3] if depth > 2 else [2, 3, 4])))
        return f"<{tag}{attrs}>{body}{kids}</{tag}>"

    return f"<html><body>{tree(0)}<p>after</p></body></html>"


def test_discovery_equals_a_recursive_search(spark):
    rng = random.Random(11)
    pages = [(i, random_page(rng)) for i in range(300)]
    # the parser reads pages leniently: links within links are kept apart as they stand, as in the tree
    links = elements.links_of(elements.parsed(spark.createDataFrame(pages, "page_id long, html string").repartition(4)))
    got = {}
    for r in discover.discover(links).collect():
        got.setdefault(r["page_id"], {})[r["card"]] = (r["sponsored"], r["href"])
    want = {i: brute(p) for i, p in pages}
    assert got == {i: f for i, f in want.items() if f}
    kinds = [x[0] for f in want.values() for x in f.values()]
    assert kinds.count(True) > 50 and kinds.count(False) > 300


def test_feed_page(spark):
    cell = '<div class="cell"><div><a href="/marketplace/item/{0}/"><img src="https://i.example/{0}.jpg"></a><a aria-label="Oak desk {0} in Bend, OR" href="/marketplace/item/{0}/?r=1"><span>$2{0}</span><span>Oak desk {0}</span><span>Bend, OR</span><i aria-label="View in 3D"></i></a></div></div>'
    ad = '<div class="cell"><div><a href="https://l.facebook.com/l.php?u=x">Great lamps</a><span>Sponsored</span><a href="/ads/about">Why this ad</a></div></div>'
    page = f'<body><div role="main"><div>{cell.format(1)}{ad}{cell.format(2)}<div class="cell"><b class="gleaner-badge">hidden</b>{cell.format(3)}</div></div></div></body>'
    pages = elements.parsed(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>no links")], "page_id long, html string"))
    found = discover.snapshots(pages, discover.discover(elements.links_of(pages))).orderBy("card")
    rows = extract.card_columns(found, label="label", labels="labels").collect()
    assert [(r["title"], r["price_text"], r["location_text"], r["sponsored"], r["image_url"]) for r in rows] == [
        ("Oak desk 1", "$21", "Bend, OR", False, "https://i.example/1.jpg"), ("Great lamps", "", "", True, None), ("Oak desk 2", "$22", "Bend, OR", False, "https://i.example/2.jpg"),
        ("Oak desk 3", "$23", "Bend, OR", False, "https://i.example/3.jpg"),
    ]
    assert rows[0]["text_lines"] == ["$21", "Oak desk 1", "Bend, OR", "View in 3D"] and rows[1]["text_lines"] == ["Great lamps", "Sponsored", "Why this ad"]
    assert all(r["safe"] for r in rows) and found.select(T.item_id(F.col("href")).alias("i")).where("i is not null").count() == 3


def test_a_wide_page_is_linear(spark):
    page = "<body>" + "".join(f'<div><a href="/marketplace/item/{k}/">listing number {k}</a></div>' for k in range(20_000)) + "</body>"
    links = elements.links_of(elements.parsed(spark.createDataFrame([(1, page)], "page_id long, html string")))
    assert discover.discover(links).count() == 20_000
