"""From pages to listing columns: text lines, cards, details, embedded JSON, links."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from gleaner.functions import fixed as X
from gleaner.functions import text as T
from gleaner.plans.shared import ship
from gleaner.sources.elements import OWN_UI, hidden_tags

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HOSTS = r"(?:^|\.)(?:facebook\.com|fbcdn\.net)$"


class _Lines(HTMLParser):
    """Text nodes in document order; h1 texts, labels and image addresses on the side. What this library itself put into a page is none of its text."""

    def __init__(self, page: str = ""):
        super().__init__(convert_charrefs=True)
        self.lines, self.heads, self.labels, self.images, self.skip, self.h1 = [], [], [], [], 0, None
        self.quiet, self.own = hidden_tags(page), []  # own: open elements since one of this library's began

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.quiet:
            self.skip += 1
        if tag not in _VOID and (self.own or set((a.get("class") or "").split()) & OWN_UI):
            self.own.append(tag)
        if tag == "h1":
            self.h1 = ""
        if a.get("aria-label"):
            self.labels.append((tag, " ".join(a["aria-label"].split())))
        if tag == "img" and (a.get("src") or "").lower().startswith("http"):
            self.images.append(a["src"])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.quiet and self.skip:
            self.skip -= 1
        if tag in self.own:
            while self.own.pop() != tag:
                pass
        if tag == "h1" and self.h1 is not None:
            self.heads.append(" ".join(self.h1.split()))
            self.h1 = None

    def handle_data(self, data):
        if self.skip or self.own:
            return
        if self.h1 is not None:
            self.h1 += data
        line = " ".join(data.split())
        if line and (not self.lines or self.lines[-1] != line):
            self.lines.append(line)


_CLIMB = 10


class _Container(HTMLParser):
    """The main listing of an item page: its title (the last h1 of the dialog, else of the main part) with as many of the elements
    around it as hold no link to another listing and no ad unit.

    Elements are spans over the page's texts and links, so that one pass finds them all; the climb goes up at most ``_CLIMB`` parents.
    """

    def __init__(self, page: str = ""):
        super().__init__(convert_charrefs=True)
        self.texts, self.links, self.foreign, self.skip, self.quiet = [], [], 0, 0, hidden_tags(page)
        self.spans, self.open, self.hero, self.image = [], [], None, None  # span: tag, role, parent, [begin], [end]

    def _here(self):
        return len(self.texts), len(self.links), self.foreign

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.skip += tag in self.quiet
        href, src = a.get("href") or "", a.get("src") or ""
        if tag == "img":
            if self.hero is None and (a.get("alt") or "").startswith("Product photo of"):
                self.hero = src
            if self.image is None and src and any(self.spans[i][0] == "div" and self.spans[i][1] in ("main", "dialog") for i in self.open):
                self.image = src
        begin = self._here()
        if tag == "a" and "href" in a:
            self.links.append(href)
            self.foreign += any(part in href for part in X.OTHER_LISTING_LINKS)
        if tag not in _VOID:
            # a link is part of what holds it, not of itself
            self.spans.append([tag, a.get("role"), self.open[-1] if self.open else None, (*begin[:2], self.foreign), None])
            self.open.append(len(self.spans) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(self.spans[i][0] == tag for i in reversed(self.open)):
            return
        while True:
            i = self.open.pop()
            self.spans[i][4] = self._here()
            self.skip -= self.spans[i][0] in self.quiet
            if self.spans[i][0] == tag:
                return

    def handle_data(self, data):
        if not self.skip:
            self.texts.append(data)

    def result(self):
        """Lines, title, links and image; None without a container."""
        end = self._here()
        for s in self.spans:
            s[4] = s[4] or end
        of = lambda role: next((i for i, s in enumerate(self.spans) if s[0] == "div" and s[1] == role), None)
        scope = of("dialog")
        scope = of("main") if scope is None else scope
        heads = [] if scope is None else [i for i, s in enumerate(self.spans) if s[0] == "h1" and self._within(i, scope)]
        if not heads:
            return None
        at = node = heads[-1]
        for _ in range(_CLIMB):
            if self.spans[node][4][2] > self.spans[node][3][2]:
                break
            at = node
            if node == scope:
                break
            node = self.spans[node][2]
        (t0, l0, _), (t1, l1, _) = self.spans[at][3:5]
        lines = []
        for text in self.texts[t0:t1]:
            line = " ".join(text.split())
            if line and (not lines or lines[-1] != line):
                lines.append(line)
        (h0, _, _), (h1, _, _) = self.spans[heads[-1]][3:5]
        image = self.hero if self.hero is not None else self.image
        return lines, " ".join("".join(self.texts[h0:h1]).split()), self.links[l0:l1], image if (image or "").lower().startswith(("http:", "https:")) else None

    def _within(self, i, scope):
        while i is not None and i > scope:
            i = self.spans[i][2]
        return i == scope


_LIST = S.ArrayType(S.StringType())
_DETAIL = S.StructType([S.StructField("lines", _LIST), S.StructField("title", S.StringType()), S.StructField("links", _LIST), S.StructField("image", S.StringType())])


@F.pandas_udf(_DETAIL)
def detail_container(pages: pd.Series) -> pd.DataFrame:
    """Lines, title, links and image of a page's main listing; lines are null where the page has none (or is null)."""
    out = []
    for page in pages:
        p = _Container(page or "")
        p.feed(page or "")
        p.close()
        out.append(p.result() or (None, None, None, None))
    return pd.DataFrame(out, columns=["lines", "title", "links", "image"])


_PARSED = S.StructType([S.StructField("lines", _LIST), S.StructField("title", S.StringType()), S.StructField("labels", _LIST), S.StructField("image", S.StringType())])


@F.pandas_udf(_PARSED)
def parse_html(pages: pd.Series) -> pd.DataFrame:
    """Visible lines (equal neighbours once), last h1, the first 12 labels, the first image of each page."""
    out = []
    for page in pages:
        p = _Lines(page or "")
        if page:
            p.feed(page)
            p.close()
        # the first twelve labelled elements, of which those of links and images then do not count
        labels = [x for tag, x in p.labels[: X.LABELS_MAX] if tag not in ("a", "img") and x and len(x) <= X.LABEL_CHARS_MAX and x not in p.lines]
        out.append((p.lines, p.heads[-1] if p.heads else None, labels, p.images[0] if p.images else None))
    return pd.DataFrame(out, columns=["lines", "title", "labels", "image"])


def page_lines(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with ``parsed``: lines, title, labels and image of each page."""
    ship(df.sparkSession)
    return df.withColumn("parsed", parse_html(F.col(html)))


def _first(lines: Column, keep) -> Column:
    return F.get(F.filter(lines, keep), F.lit(0))


def clean_title(title: Column, location: Column) -> Column:
    """Without platform words, leading marks and a trailing " in <place>"."""
    t = F.regexp_replace(F.regexp_replace(title, r"(?i)\bFacebook\b", ""), r"(?i)\bMarketplace\b:?\s*", "")
    t = T.normalize(F.regexp_replace(t, r"^[:\-\s]+", ""))
    place = F.regexp_replace(T.normalize(location), r"(?i)\s*[·|]\s*\d+\s*(?:mi|km)\s+away$", "")
    tail = F.concat(F.lit(" in "), place)
    cut = F.rtrim(F.substring(t, F.lit(1), F.length(t) - F.length(tail)))
    return F.when((place != "") & F.endswith(F.lower(t), F.lower(tail)), cut).otherwise(t)


def card_columns(df: DataFrame, lines: str = "text_lines", label: str | None = None, labels: str | None = None) -> DataFrame:
    """title, price_text, location_text, seller_text, visible_text of a card's lines; ``labels`` (array, as ``parse_html`` has them) join lines and text at last."""
    ls = F.coalesce(F.col(lines), F.array().cast("array<string>"))
    price = F.coalesce(_first(ls, lambda x: T.has(x, X.CARD_PRICE)), F.lit(""))
    place = F.coalesce(_first(ls, lambda x: T.has(x, X.AWAY_LINE)), _first(ls, lambda x: x.rlike(X.PLACE_LINE)), F.lit(""))
    out = df.withColumns({"price_text": price, "location_text": place, "visible_text": T.normalize(F.array_join(ls, "\n"))})
    named = F.nullif(clean_title(F.coalesce(F.col(label), F.lit("")) if label else F.lit(""), F.col("location_text")), F.lit(""))
    line = _first(ls, lambda x: (x != F.col("price_text")) & (x != F.col("location_text")) & ~T.has(x, X.NOT_TITLE))
    title = F.coalesce(named, line, F.substring("visible_text", 1, 120))
    out = out.withColumns({"title": title, "seller_text": F.coalesce(seller_text(ls), F.lit(""))})
    if labels is None:
        return out
    more = F.filter(F.coalesce(F.col(labels), F.array().cast("array<string>")), lambda x: ~F.array_contains(ls, x))
    text = T.normalize(F.array_join(F.concat(F.array("visible_text"), more), "\n"))
    # one after the other: within one call, a lambda would see the new lines
    out = out.withColumn("visible_text", F.when(F.size(more) > 0, text).otherwise(F.col("visible_text")))
    return out.withColumn(lines, F.concat(ls, more))


def seller_text(lines: Column) -> Column:
    normal = F.transform(lines, T.normalize)
    return _first(normal, lambda x: (F.length(x) <= 120) & T.has(x, X.SELLER_LINE) & ~T.has(x, X.SELLER_CHROME))


def detail_columns(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The listing columns of an item page's main part; its outbound links join the lines. ``found`` is false, and the columns
    are empty, on pages without a main part that has a heading."""
    ship(df.sparkSession)
    out = df.withColumn("_p", detail_container(F.col(html)))
    none = F.array().cast("array<string>")
    lines, links = F.coalesce("_p.lines", none), platform_free(F.coalesce("_p.links", none))
    price = F.coalesce(_first(lines, lambda x: T.has(x, X.DETAIL_PRICE)), F.lit(""))
    listed = F.coalesce(_first(lines, lambda x: T.has(x, r"^listed\b.+\bin\b")), F.lit(""))
    new = {
        "title": F.coalesce(F.nullif("_p.title", F.lit("")), F.get(lines, F.lit(0)), F.lit("")), "price_text": price,
        "location_text": T.normalize(F.regexp_extract(listed, r"(?i)\bin\s+(.{2,60})$", 1)), "text_lines": F.concat(lines, links),
        "image_url": F.col("_p.image"), "item_id": T.item_id(F.col(url)), "found": F.col("_p.lines").isNotNull(),
    }
    return out.withColumns(new).withColumn("visible_text", T.normalize(F.array_join("text_lines", "\n"))).drop("_p")


def fetched_listing(df: DataFrame, html: str = "html", item: str = "item_id") -> DataFrame:
    """Listing columns of a fetched item page: its embedded JSON, else its main part if that has a title and 12 characters of text.

    ``found`` is false, and the listing columns are null, where neither gives a listing.
    """
    names = ("title", "price_text", "location_text", "text_lines", "visible_text", "url")
    cols = [c for c in df.columns if c not in (*names, "found", "image_url")]
    url = F.concat(F.lit("https://www.facebook.com/marketplace/item/"), F.col(item), F.lit("/"))
    json = embedded_listing(df.select(*cols), html, item)
    json = json.select(*cols, F.struct("found", *names).alias("_json"))
    page = detail_columns(json.withColumns({"_item": F.col(item), "url": url}), html, "url")
    fits = F.col("found") & (F.col("title") != "") & (F.length("visible_text") >= 12)
    pick = {c: F.when(F.col("_json.found"), F.col(f"_json.{c}")).when(fits, F.col(c)) for c in names}
    pick |= {"image_url": F.when(~F.col("_json.found") & fits, F.col("image_url")), item: F.col("_item"), "found": F.col("_json.found") | fits}
    return page.withColumns(pick).select(*cols, *names, "image_url", "found")


def outbound_links(html: Column) -> Column:
    """Distinct http(s) links in order; the platform's own are dropped, its redirects unwrapped."""
    refs = F.regexp_extract_all(html, F.lit("(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return platform_free(F.transform(refs, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&"))))


def platform_free(refs: Column) -> Column:
    """The outbound ones of an array of link targets."""
    refs = F.filter(refs, lambda h: h.rlike("(?i)^https?://"))

    def unwrap(h: Column) -> Column:
        own = F.coalesce(F.lower(F.try_parse_url(h, F.lit("HOST"))).rlike(_HOSTS), F.lit(False))
        inner = F.when(F.try_parse_url(h, F.lit("PATH")) == "/l.php", F.try_url_decode(F.try_parse_url(h, F.lit("QUERY"), F.lit("u"))))
        return F.when(own, F.when(inner.rlike("(?i)^https?://"), inner)).when(F.try_parse_url(h, F.lit("HOST")).isNotNull(), h)

    return F.array_distinct(F.filter(F.transform(refs, unwrap), lambda h: h.isNotNull()))


def _json_string(html: Column, pattern: str) -> Column:
    raw = F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    decoded = F.from_json(F.concat(F.lit('{"v":"'), raw, F.lit('"}')), "v string")["v"]
    return F.nullif(F.trim(decoded), F.lit(""))


_STRING = r'"((?:\\.|[^"\\])*)"'


def embedded_listing(df: DataFrame, html: str = "html", item: str = "item_id") -> DataFrame:
    """Listing columns from a page's embedded JSON; ``found`` is false without title, or without description and price."""
    h = F.coalesce(F.col(html), F.lit(""))
    title = _json_string(h, r'"marketplace_listing_title"\s*:\s*' + _STRING)
    text = F.coalesce(_json_string(h, r'"redacted_description"\s*:\s*\{\s*"text"\s*:\s*' + _STRING), _json_string(h, r'"listing_description"\s*:\s*\{?\s*"?text"?\s*:?\s*' + _STRING))
    price = F.coalesce(_json_string(h, r'"formatted_amount"\s*:\s*' + _STRING), _json_string(h, r'"formatted_price"\s*:\s*\{\s*"text"\s*:\s*' + _STRING))
    out = df.withColumns({"title": title, "_text": text, "_price": price})
    flag = lambda name: h.rlike(rf'"{name}"\s*:\s*true')
    shown = F.concat_ws(" · ", "_price", F.when(flag("is_sold"), "sold"), F.when(flag("is_pending"), "pending"))
    out = out.withColumns({"found": F.col("title").isNotNull() & (F.col("_text").isNotNull() | F.col("_price").isNotNull()), "price_text": shown})
    lines = F.filter(F.concat(F.array("price_text", "title"), F.coalesce(F.split("_text", "\r?\n"), F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    url = F.concat(F.lit("https://www.facebook.com/marketplace/item/"), F.col(item), F.lit("/"))
    return out.withColumns({"text_lines": lines, "url": url, "location_text": F.lit("")}).withColumn("visible_text", F.array_join("text_lines", "\n")).drop("_text", "_price")


def login_wall(html: Column, response_url: Column) -> Column:
    form = T.has(html, r'id="loginform"|name="login"|data-testid="royal_login_form"')
    return response_url.rlike(r"/(?:login|checkpoint)\b") | (form & ~F.contains(html, F.lit("marketplace_listing_title")))
