"""Pages as intervals of elements: what card discovery, and every other question about nesting, is asked of.

A page is parsed once, in document order. Every element is an interval of that order; what it holds (listing links, text, headings,
ad marks) is the difference of running counts at its ends, so that an element of any size costs the same. A link carries the
nearest ``CLIMB`` elements around it.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed as X
from gleaner.plans.shared import ship

#: Classes of what this library itself puts into pages; its text is never a page's.
TOOLBAR = "gleaner-toolbar"
OWN_UI = {TOOLBAR, "gleaner-badge", "gleaner-banner"}
MARK = "data-gleaner"
_QUIET = ("script", "style", "noscript", "template")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_ENDS = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_SPACE = re.compile("[\\s ﻿]+")
_SIZE = re.compile(r"(width|height)\s*:\s*([0-9]+)px")

NODE = "struct<el:int,stop:boolean,safe:boolean,own:boolean,items:int,first_item:int,raw:int,clean:int,sponsored:int,l0:int,l1:int,a0:int,a1:int,i0:int,i1:int,width:int,height:int>"
LINK = f"struct<link:int,href:string,label:string,is_item:boolean,is_ad:boolean,rank:int,marked:{NODE},path:array<{NODE}>>"
PARSED = f"links array<{LINK}>, lines array<string>, labels array<struct<tag:string,text:string>>, images array<string>"


def hidden_tags(page: str) -> set[str]:
    """Elements whose text does not count; one that is never closed would hide the rest of the page, and does not."""
    low = page.lower()
    return {t for t in _QUIET if t in ("script", "style") or low.count(f"</{t}") >= low.count(f"<{t}")}


def tidy(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


class _Page(HTMLParser):
    """Elements as (begin, end) counts: links, listing links, raw text, lines, sponsored lines, headings, own UI."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.quiet_tags, self.quiet, self.own = hidden_tags(page), 0, 0
        self.elements, self.open, self.links, self.lines = [], [], [], []
        self.n_items = self.raw = self.h1 = self.bars = 0
        self.kept, self.sponsored = [0], [0]  # running length of lines (equal neighbours once), and of ad marks
        self.repeats, self.labels, self.images = [], [], []
        self.feed(page)
        self.close()
        while self.open:
            self._end()

    def updatepos(self, i, j):
        return j  # nobody asks for lines and columns

    def _now(self):
        return self.n_items, self.raw, len(self.lines), self.h1, self.bars, len(self.labels), len(self.images)

    def _end(self):
        el = self.elements[self.open.pop()]
        el["end"] = self._now()
        self.quiet -= el["tag"] in self.quiet_tags
        self.own -= el["ui"]

    def handle_starttag(self, tag, attrs):
        if self.open and self.elements[self.open[-1]]["tag"] in _ENDS.get(tag, ()):
            self._end()
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        ui, bar = not OWN_UI.isdisjoint(classes), TOOLBAR in classes
        style = dict(_SIZE.findall(a["style"])) if a.get("style") else {}
        size = [int(v) if (v := style.get(k) or a.get(k) or "").isdigit() else None for k in ("width", "height")]
        self.h1 += tag == "h1"
        parent = self.open[-1] if self.open else None
        self.bars += bar
        self.own += ui
        if a.get("aria-label") and tag not in _QUIET:
            self.labels.append((tag, tidy(a["aria-label"])))
        if tag == "img" and a.get("src"):
            self.images.append(a["src"])
        marked = len(self.elements) if MARK in a else None if parent is None else self.elements[parent]["marked"]
        href = a.get("href") if tag == "a" else None
        is_item = href is not None and any(x in href for x in X.OTHER_LISTING_LINKS[:3])
        self.n_items += is_item
        # counts of what an element holds start after itself
        el = {"tag": tag, "role": a.get("role"), "ui": ui, "own": bar or (parent is not None and self.elements[parent]["own"]), "size": size, "parent": parent, "marked": marked, "begin": self._now(), "end": None}
        self.elements.append(el)
        if href is not None:
            is_ad = any(x in href for x in X.AD_LINKS) or href.startswith(X.AD_LINK_START)
            self.links.append((len(self.elements) - 1, href, a.get("aria-label"), is_item, is_ad, self.n_items - 1 if is_item else None))
        self.open.append(len(self.elements) - 1)
        self.quiet += tag in self.quiet_tags
        if tag in _VOID:
            self._end()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._end()

    def handle_endtag(self, tag):
        if tag not in _VOID and any(self.elements[i]["tag"] == tag for i in self.open):
            while self.elements[self.open[-1]]["tag"] != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        self.raw += len(data)
        if self.quiet or self.own or not (line := tidy(data)):
            return
        again = bool(self.lines) and self.lines[-1] == line
        self.lines.append(line)
        self.repeats.append(again)
        self.kept.append(self.kept[-1] + (0 if again else len(line) + 1))
        self.sponsored.append(self.sponsored[-1] + (len(line) < 12 and bool(re.search(X.LONE_SPONSORED, line, re.I))))

    def node(self, i: int) -> dict:
        el = self.elements[i]
        (n0, r0, l0, h0, u0, a0, i0), (n1, r1, l1, h1, u1, a1, i1) = el["begin"], el["end"]
        clean = 0
        if l1 > l0:  # the first line counts, whatever stood before the element
            clean = self.kept[l1] - self.kept[l0] + (len(self.lines[l0]) + 1 if self.repeats[l0] else 0) - 1
        region = el["tag"] == "main" or el["role"] in ("main", "dialog")
        return {
            "el": i, "stop": region or h1 > h0, "safe": not (region or el["tag"] == "body" or el["role"] in ("navigation", "banner") or h1 > h0 or u1 > u0), "own": el["own"], "items": n1 - n0,
            "first_item": n0, "raw": r1 - r0, "clean": clean, "sponsored": self.sponsored[l1] - self.sponsored[l0], "l0": l0, "l1": l1, "a0": a0, "a1": a1, "i0": i0, "i1": i1, "width": el["size"][0], "height": el["size"][1],
        }

    def result(self) -> dict:
        links = []
        for k, (i, href, label, is_item, is_ad, rank) in enumerate(self.links):
            path, at = [], i
            if is_item or is_ad:
                while at is not None and self.elements[at]["tag"] != "body" and len(path) < X.CLIMB:
                    path.append(self.node(at))
                    at = self.elements[at]["parent"]
                mark = self.elements[i]["marked"]
                links.append({"link": k, "href": href, "label": label, "is_item": is_item, "is_ad": is_ad, "rank": rank, "marked": None if mark is None else self.node(mark), "path": path})
        labels = [{"tag": tag, "text": text} for tag, text in self.labels]
        return {"links": links, "lines": self.lines, "labels": labels, "images": self.images}


def parsed(pages: DataFrame, html: str = "html", page: str = "page_id") -> DataFrame:
    """One row a page: its listing and ad links with the elements around them, lines, labels and images.

    Null and empty pages have none of them.
    """
    ship(pages.sparkSession)
    # dealt to all cores: parsing is much work for each byte, and a file may be one task
    spark = pages.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = pages.select(F.col(page).alias("page_id"), F.col(html).cast("string").alias("html")).repartition(n)
    schema = src.select("page_id", *[F.lit(None).cast(t).alias(n) for n, t in (x.split(" ", 1) for x in PARSED.split(", "))]).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [_Page(h or "").result() for h in part.column(1).to_pylist()]
                cols = [pa.array([r[f.name] for r in rows], f.type) for f in list(kinds)[1:]]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=kinds.names)

    return src.mapInArrow(run, schema)


def links_of(pages: DataFrame) -> DataFrame:
    """Listing and ad links of ``parsed`` pages, a row each."""
    return pages.select("page_id", F.explode("links").alias("l")).select("page_id", "l.*")
