"""Which elements of a page are cards: the largest ones around a listing link that hold one listing only, and the ad units between them.

Input are links with the elements around them (``sources.elements.links_of``, or any table of that form): page_id, link (its place on
the page), href, is_item, is_ad, rank (place among the listing links), marked (an element that is known to be a card) and path, the nearest elements
outwards, each with the interval of listing links that it holds. Whether an interval holds one listing only is a question about runs: links in order
of rank fall into runs of equal listings, and an element holds one listing if its interval lies in the run of the link that it was reached from. That
takes one exchange by page and no pairs of elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import fixed as X
from gleaner.functions import text as T


def _large(n: Column) -> Column:
    """Elements of unknown size count as large enough."""
    wide, high = F.coalesce(n["width"], F.lit(X.CARD_WIDTH)), F.coalesce(n["height"], F.lit(X.CARD_HEIGHT))
    return (wide >= X.CARD_WIDTH) & (high >= X.CARD_HEIGHT)


def _climb(path: Column, stop, fits, halt=None) -> Column:
    """The outermost element that fits, below the first one that stops the climb and not beyond the first that halts it; null without one."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    state = lambda i, at, done: F.struct(i.alias("i"), at.alias("at"), done.alias("done"))

    def step(a, n):
        over = a["done"] | sure(stop(n))
        return state(a["i"] + 1, F.when(~over & sure(fits(n)), a["i"]).otherwise(a["at"]), over | sure(halt(n)) if halt else over)

    # one walk outwards, which remembers where the last fitting element was
    return F.get(path, F.aggregate(path, state(F.lit(0), F.lit(-1), F.lit(False)), step, lambda a: F.nullif(a["at"], F.lit(-1))))


def _first(found: DataFrame) -> DataFrame:
    """One row an element: the first of the links that lead to it."""
    kept = ("link", "href", "label", "safe", "l0", "l1", "a0", "a1", "i0", "i1")
    kept = [c for c in kept if c in found.columns]
    return found.groupBy("page_id", "card").agg(F.min_by(F.struct(*kept), "link").alias("f")).select("page_id", "card", "f.*")


def _rows(links: DataFrame, node: Column, node_type: list[str]) -> DataFrame:
    out = links.withColumn("_n", F.coalesce("marked", node))
    return out.withColumns({"card": F.col("_n")["el"]} | {c: F.col("_n")[c] for c in ("safe", "own", "l0", "l1", "a0", "a1", "i0", "i1") if c in node_type})


def _node_fields(links: DataFrame) -> list[str]:
    return links.schema["path"].dataType.elementType.names


def _runs(links: DataFrame) -> DataFrame:
    """Links with the first and last rank of their run of equal listings."""
    rows = links.withColumn("_key", F.coalesce(T.item_id(F.col("href")), "href"))
    order = W.partitionBy("page_id", "is_item").orderBy("rank")
    rows = rows.withColumn("_new", (~F.col("_key").eqNullSafe(F.lag("_key").over(order))).cast("int")).withColumn("_run", F.sum("_new").over(order))
    run = W.partitionBy("page_id", "is_item", "_run")
    return rows.withColumns({"_lo": F.min("rank").over(run), "_hi": F.max("rank").over(run)})


def _card_node() -> Column:
    """Of ``_runs``: the card around a listing link."""
    one = lambda n: (n["items"] >= 1) & (n["first_item"] >= F.col("_lo")) & (n["first_item"] + n["items"] - 1 <= F.col("_hi"))
    fits = lambda n: one(n) & n["raw"].between(X.CARD_TEXT_MIN, X.CARD_TEXT_MAX) & _large(n)
    halt = lambda n: ((n["items"] >= 1) & ~one(n)) | (n["items"] > X.CARD_LINKS_STOP) | (n["raw"] > X.CARD_TEXT_STOP)
    return F.coalesce(_climb(F.col("path"), lambda n: n["stop"], fits, halt), F.get("path", F.lit(0)))


def _cell_node() -> Column:
    """The ad unit around an ad link."""
    stop = lambda n: n["stop"] | (n["clean"] > X.CARD_TEXT_MAX) | (n["items"] > 0)
    fits = lambda n: (n["sponsored"] > 0) & (n["clean"] >= X.CARD_TEXT_MIN) & _large(n)
    return _climb(F.col("path"), stop, fits)


def cards(links: DataFrame) -> DataFrame:
    """page_id, card (element), link and href (the first link to it) of all listing cards.

    A card holds links to one listing only and 8 to 1400 characters; a climb ends below main parts, dialogs and elements with a heading, and at
    elements with other listings, more than three links or more than 1600 characters. Without such an element the link itself is the card. A
    marked element is the card of all links in it; what lies in this library's own elements is none.
    """
    fields = _node_fields(links)
    found = _rows(_runs(links.where("is_item")), _card_node(), fields)
    return _first(found.where(~F.coalesce("own", F.lit(False))) if "own" in fields else found)


def sponsored_cells(links: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """page_id, card, link, href of ad units: the outermost elements around an ad link with a line "Sponsored" of its own and without a listing.

    Elements that are listing cards already (``found``) are none.
    """
    if found is None:
        return discover(links).where("sponsored").drop("sponsored")
    fields = _node_fields(links)
    cells = _rows(links.where("is_ad"), _cell_node(), fields).where("card is not null")
    cells = _first(cells.where(~F.coalesce("own", F.lit(False))) if "own" in fields else cells)
    return cells.join(found.select("page_id", "card"), ["page_id", "card"], "left_anti")


def discover(links: DataFrame) -> DataFrame:
    """Cards and ad units of all pages, from one look at the links; ``sponsored`` tells them apart."""
    fields = _node_fields(links)
    way = lambda on, node, ad: F.when(F.col(on), F.struct(F.coalesce("marked", node).alias("n"), F.lit(ad).alias("ad")))
    ways = F.filter(F.array(way("is_item", _card_node(), False), way("is_ad", _cell_node(), True)), lambda w: w.isNotNull())
    kept = [c for c in ("link", "href", "label") if c in links.columns]
    rows = _runs(links).select("page_id", *kept, F.explode(ways).alias("w")).where("not w.ad or w.n.el is not null")
    if "own" in fields:
        rows = rows.where("not coalesce(w.n.own, false)")
    kept = [F.col(c) for c in kept] + [F.col(f"w.n.{c}") for c in ("safe", "l0", "l1", "a0", "a1", "i0", "i1") if c in fields]
    # an element that a listing link leads to is a card, whatever else leads there
    first = F.min_by(F.struct(*kept, F.col("w.ad").alias("sponsored")), F.struct("w.ad", "link")).alias("f")
    return rows.groupBy("page_id", F.col("w.n.el").alias("card")).agg(first).select("page_id", "card", "f.*")


def snapshots(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with what a card shows: text_lines, labels, image_url. ``pages`` are parsed ones; a page's lines are one row of the join."""
    out = found.join(pages.select("page_id", "lines", "labels", "images"), "page_id")
    inside = F.slice("lines", F.col("l0") + 1, F.col("l1") - F.col("l0"))
    lines = F.filter(inside, lambda x, i: (i == 0) | (x != F.get(inside, F.greatest(i - 1, F.lit(0)))))
    # the first twelve labelled elements, of which links and images then do not count
    labelled = F.slice(F.slice("labels", F.col("a0") + 1, F.col("a1") - F.col("a0")), 1, X.LABELS_MAX)
    good = F.filter(labelled, lambda x: ~x["tag"].isin("a", "img") & (x["text"] != "") & (F.length(x["text"]) <= X.LABEL_CHARS_MAX))
    image = F.when(F.col("i1") > F.col("i0"), F.get("images", F.col("i0")))
    new = {"text_lines": lines, "labels": F.transform(good, lambda x: x["text"]), "image_url": F.when(image.rlike("(?i)^https?:"), image)}
    return out.withColumns(new).drop("lines", "images", "l0", "l1", "a0", "a1", "i0", "i1")
