"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of tokens: words and tags. A word scores by the element it stands in
(positive in running text, negative in links outside of it), a tag scores
negative; the weights are log-odds learned from labelled pages. One linear
scan (the classic largest-sum scan) finds the contiguous region with the largest total: the article,
which is put out block by block.

Boxes that HTML marks as no text (nav, form, footer, hidden ...) or whose names (words of classes and ids) add up to boilerplate are cut out of
the scan. Both are hints, and the words outvote them: the scan runs with all cuts, and again for each of the largest boxes (``_TRIES`` by name, as many by
tag) with that box and those around it left in. A region that scores more than ``_OUTVOTE`` times what all cuts leave is the article, however its box is
named; of several, the one of highest score for each box that it needs (where all are cut by their names only, the score counts double), and the other boxes in it
stay cut. What readers say (``_TALK``) reads like an article, so its words outvote nothing but an empty page. Names have learned weights; those that usually mean boilerplate start at a prior, which
labelled pages can turn. Of an element's names, and of those of all open elements, the first 64 count.

``fit_weights`` learns from pages whose main region is known. Pages that mark it themselves (an
``article`` or ``main`` element) are such pages, and serve as labelled pages by default: at most
``max_pages`` of them, lowest id hashes first. Each (element, in link) context has a weight; contexts
never seen in training get a fixed prior by kind of element. Such elements only teach weights: the
region put out is the scan's, with or without them.

Defined cases: a null or empty page gives an empty text; malformed markup is read leniently (tags that
are never closed, ``<`` in text, truncated pages); repeated rows are extracted each on its own; extra
columns are ignored; very long pages and any nesting are read in linear time.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import chunked, ship, table

_RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "label", "input", "head", "header"}
_BOILER_WORDS = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|disqus|replies|reply|respond|sidebar|side-bar|widget|menu|nav\w*|breadcrumbs?|"
    r"footer|header|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|"
    r"recommend\w*|pagination|pager|toolbar|login|search|copyright|disclaimer|toc|skip|hidden)"
)
_TALK = re.compile(r"comments?|disqus|replies|reply|respond")
_BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
_MAIN = {"article", "main"}
_CLOSES_P = _BLOCK - {"body", "html", "head"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACES = re.compile(r"\s+")
_WORDS = re.compile(r"[^a-z0-9]+")
_NAME_PRIOR, _CUT = -3.0, -2.0
_OUTVOTE, _TRIES = 8.0, 4
_STOPS = ("ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "nav", "aside", "footer", "header", "form")
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_PRIOR = {"text": 1.0, "link": -0.5, "tag": -0.6}


def _names(tag: str, attrs: str) -> tuple[list[str], bool]:
    """Words of an element's class and id; whether its role or attributes make it no text."""
    names, no_text = [], False
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name in ("class", "id"):
            if tag not in ("body", "html", *_MAIN):
                names += [w for w in _WORDS.split(value.lower()) if w]
        elif name == "role":
            no_text |= value.lower() in _BOILER_ROLES
        else:
            no_text |= name == "hidden" or name == "aria-hidden" and value.lower() == "true"
    return names[:64], no_text


class Page:
    """A page as a sequence of (kind, context, text, box, main, names, words): kind "tag", "block" (a block starts or ends) or "text".

    ``box`` is the innermost open element that is boilerplate by its tag, role or names (-1: none); ``parent`` and ``held`` give each such box the one
    around it and the words in it. ``names`` are those of the open elements (at most 64). An open element keeps what holds inside it, and where each
    kind of element was opened last is known, so that reading is linear whatever the depth.
    """

    def __init__(self, page: str, weights: dict[str, float] | None = None):
        self.seq: list[tuple] = []
        self.parent: list[int] = []
        self.held: list[int] = []  # words before the box, then in it
        self.tagged: list[bool] = []  # by its tag or role, not just its names
        self.talk: list[bool] = []  # readers' comments by its names
        self.words = 0
        self._stack: list[tuple] = []  # (tag, box, inside main, nearest block, "a:" in a link, evidence of names, names, own box)
        self._at: dict[str, list[int]] = {}  # places in the stack by tag
        self._blocks: list[int] = []
        self._read(page, weights.get if weights is not None else None)
        self._drop(0)

    def _top(self) -> tuple:
        return self._stack[-1] if self._stack else ("", -1, False, "", "", 0.0, (), False)

    def _drop(self, k: int) -> None:
        while len(self._stack) > k:
            tag, box, *_, own = self._stack.pop()
            self._at[tag].pop()
            if tag in _BLOCK:
                self._blocks.pop()
            if own:
                self.held[box] = self.words - self.held[box]

    def _last(self, tags) -> int:
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=-1)

    def _text(self, text: str) -> None:
        _, box, main, block, link, _, names, _ = self._top()
        n = len(text.split())
        self.words += n
        self.seq.append(("text", link + block, text, box, main, names, n))

    def _mark(self, tag: str, box: int, main: bool, names: tuple) -> None:
        self.seq.append(("block" if tag in _BLOCK else "tag", tag, "", box, main, names, 1))

    def _end(self, tag: str) -> None:
        k = self._last((tag,))
        # an end tag of an inline element does not close blocks around it
        if k >= 0 and (tag in _BLOCK or not self._blocks or self._blocks[-1] < k):
            self._drop(k)
        _, box, main, _, _, _, names, _ = self._top()
        self._mark(tag, box, main, names)

    def _read(self, page: str, weigh) -> None:
        at, n, raw = 0, len(page), None
        while at < n:
            if raw:  # inside an element of raw text: only its end tag ends it
                m = re.compile(rf"</{raw}[\s/>]", re.I).search(page, at)
                at, raw = (m.start() if m else n), None
                continue
            m = _TOKEN.search(page, at)
            stop = m.start() if m else n
            if stop > at:
                self._text(page[at:stop])
            if not m:
                return
            at = m.end()
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                if m["cdata"]:
                    self._text(m["cdata"])
            elif m["end"] or m["end2"]:
                self._end(tag)
            elif self._start(tag, m["attrs"] or m["attrs2"] or "", weigh):
                raw = tag

    def _start(self, tag: str, attrs: str, weigh) -> bool:
        """Opens an element; whether raw text follows."""
        if tag in _CLOSES_P and (k := self._last((*_ENDS.get(tag, ()), "p"))) > self._last(_STOPS):
            self._drop(k)  # a block's start ends an open paragraph, list item or cell
        _, box, main, block, link, evidence, names, _ = self._top()
        own, no_text = _names(tag, attrs) if attrs else ([], False)
        main = main or tag in _MAIN or 'role="main"' in attrs
        boiler, told = no_text or (tag in _BOILER_TAGS and not (tag == "header" and main)), 0.0
        if own:
            names = names if len(names) >= 64 else (*names, *own)
            if weigh:
                told = sum(weigh(f"name:{w}", _prior(w)) for w in own)
                evidence = max(-4.0, min(1.0, evidence + told))
        if mine := boiler or (told < 0 and evidence <= _CUT):
            self.parent.append(box)
            self.held.append(self.words)
            self.tagged.append(boiler)
            self.talk.append(any(_TALK.fullmatch(w) for w in own))
            box = len(self.parent) - 1
        block, link = (tag, "") if tag in _BLOCK else (block, "a:" if tag == "a" else link)
        self._mark(tag, box, main, names)
        if tag in _RAW or tag in _VOID or (attrs.endswith("/") and tag not in _BLOCK):
            if mine:
                self.held[box] = 0
            return tag in _RAW and not attrs.rstrip().endswith("/")
        self._at.setdefault(tag, []).append(len(self._stack))
        if tag in _BLOCK:
            self._blocks.append(len(self._stack))
        self._stack.append((tag, box, main, block, link, evidence, names, mine))
        return False

    def around(self, box: int) -> list[int]:
        """A box and those that it lies in, innermost first."""
        out = []
        while box >= 0:
            out.append(box)
            box = self.parent[box]
        return out

    def candidates(self) -> list[int]:
        """The boxes of most words: some by name, some by tag."""
        order = sorted(range(len(self.parent)), key=lambda b: (-self.held[b], b))
        return [b for kind in (False, True) for b in [b for b in order if self.tagged[b] is kind and self.held[b]][:_TRIES]]

    def cut(self, kept: set[int] | frozenset = frozenset()) -> list[bool]:
        """Of each box whether it is cut; boxes in a cut one are."""
        out: list[bool] = []
        for box, up in enumerate(self.parent):
            out.append(box not in kept or (up >= 0 and out[up]))
        return out


def _prior(name: str) -> float:
    return _NAME_PRIOR if _BOILER_WORDS.fullmatch(name) else 0.0


def _weight(weights: dict[str, float], kind: str, context: str) -> float:
    if (known := weights.get(f"{kind}:{context}")) is not None:
        return known
    if kind != "text":
        return _PRIOR["tag"]
    return _PRIOR["link"] if context.startswith("a:") else _PRIOR["text"]


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The page's main text: blocks in page order, joined by an empty line."""
    if not page:
        return ""
    read = Page(page, weights)
    cut = read.cut()
    score, lo, hi = _region(read.seq, cut, weights)
    best = None
    for box in read.candidates():
        kept = read.around(box)
        if 2.0 * read.held[kept[-1]] + score <= _OUTVOTE * score or (score > 0 and any(read.talk[k] for k in kept)):  # no weight is above 2
            continue
        less = read.cut(set(kept))
        found = _region(read.seq, less, weights)
        key = found[0] * (1 if any(read.tagged[k] for k in kept) else 2) / len(kept)
        if found[0] > _OUTVOTE * score and (best is None or key > best[0]):
            best = key, less, found
    if best:
        _, cut, (_, lo, hi) = best
    blocks, own = [], []
    for kind, context, text, box, *_ in read.seq[lo:hi]:
        if kind == "text":
            if box < 0 or not cut[box]:
                own.append(text)
        elif kind == "block":
            blocks.append(own)
            own = []
        elif context == "br":
            own.append(" ")
    blocks.append(own)
    out = (_SPACES.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
    return "\n\n".join(b for b in out if b)


def _region(seq: list, cut: list[bool], weights: dict[str, float]) -> tuple[float, int, int]:
    """The scan: best sum ending here, best sum so far. The best sum and where it lies."""
    best, best_lo, best_hi, now, lo = 0.0, 0, 0, 0.0, 0
    for i, (kind, context, _, box, _, _, n) in enumerate(seq):
        if box >= 0 and cut[box]:  # cut out in any case, so an advert within the article does not end it
            continue
        now += _weight(weights, "text" if kind == "text" else "tag", context) * n
        if now <= 0:
            now, lo = 0.0, i + 1
        elif now > best:
            best, best_lo, best_hi = now, lo, i + 1
    return best, best_lo, best_hi


def fit_counts(page: str | None) -> Counter:
    """Of a labelled page: words and tags of each context inside (1) and outside (0) the main region.

    A page whose only marked elements are boilerplate (teasers, comments) does not mark its main region: no counts.
    """
    c: Counter = Counter()
    prior = lambda names: all(_prior(w) == 0 for w in names)
    seq = Page(page).seq if page else []
    if any(main and box < 0 and prior(names) for _, _, _, box, main, names, _ in seq):
        for kind, context, _, box, main, names, n in seq:
            if box >= 0:
                continue
            if kind == "text":
                for w in set(names):
                    c[f"name:{w}", int(main)] += n
            if prior(names):
                c[f"{'text' if kind == 'text' else 'tag'}:{context}", int(main)] += n
    return c


def weights_of(counts: Counter, smooth: float = 5.0) -> dict[str, float]:
    """Log-odds of a context's words for the main region; tags are costs, never gains; names start at their prior."""
    out = {}
    for key in {k for k, _ in counts}:
        a, b = counts[key, 1], counts[key, 0]
        if key.startswith("name:"):
            half = math.exp(_prior(key[5:]) / 2)
            out[key] = max(-4.0, min(1.0, math.log((a + 4 * smooth * half) / (b + 4 * smooth / half))))
            continue
        odds = math.log((a + smooth) / (b + smooth))
        out[key] = max(-4.0, min(2.0, odds)) if key.startswith("text:") else max(-1.0, min(-0.1, odds))
    return out


def _count_pages(batches):
    for b in chunked(batches, 256):
        total: Counter = Counter()
        for p in b.column("html").to_pylist():
            total.update(fit_counts(p))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["key", "inside", "n"]
        )


def fit_weights(pages: DataFrame, max_pages: int = 2000) -> dict[str, float]:
    """Weights from labelled pages (here: those that mark their article), at most ``max_pages`` of them."""
    ship(pages.sparkSession)
    marked = pages.where(F.contains("html", F.lit("<article")) | F.contains("html", F.lit("<main")) | F.contains("html", F.lit("<ARTICLE")) | F.contains("html", F.lit("<MAIN")))
    few = marked.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    rows = pages.join(F.broadcast(few), "page_id", "left_semi").select("html").mapInArrow(_count_pages, "key string, inside int, n long")
    # contexts and names that at most ``max_pages`` pages hold; the 2,000 commonest have weights, the others their priors
    top = rows.groupBy("key", "inside").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key", "inside").limit(2000)
    return weights_of(Counter({(r["key"], r["inside"]): r["n"] for r in top.collect()}))


def _extract(sent):
    def run(batches):
        for b in chunked(batches, 256):
            texts = [extract(p, sent.value) for p in b.column("html").to_pylist()]
            b = b.drop_columns(["html"]).append_column("text", pa.array(texts, pa.string()))
            yield b.append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))

    return run


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark: SparkSession = pages.sparkSession
    ship(spark)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sent = spark.sparkContext.broadcast(weights if weights is not None else fit_weights(src))
    return src.mapInArrow(_extract(sent), "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
