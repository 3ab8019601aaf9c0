"""Cards and ad units come from one look at the links."""

from gleaner.operators import discover
from gleaner.plans import feed_queries as Q
from gleaner.sources import elements


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_discovery_looks_at_links_once(spark, tmp_path):
    spark.createDataFrame([(k, f"<p>Page {k}</p>") for k in range(63)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    both = '<div><div><a href="/ads/about?/marketplace/item/5/">Oak desk in Bend</a><p>Sponsored</p></div><a href="/ads/about">why is this here</a></div>'
    more = spark.createDataFrame([(100, both), (101, f'<section data-gleaner="1">{both}</section>'), (102, None)], "page_id long, html string")
    elements.links_of(elements.parsed(Q.feed_pages(spark, str(tmp_path)).unionByName(more))).write.parquet(f"{tmp_path}/links")
    links = spark.read.parquet(f"{tmp_path}/links")
    got = discover.discover(links)
    assert _plan(got).count("Relation") == 1 and "Join" not in _plan(got)
    cards = discover.cards(links)
    cells = discover.sponsored_cells(links, cards)
    assert sorted(map(repr, got.where("not sponsored").drop("sponsored").select(cards.columns).collect())) == sorted(map(repr, cards.collect()))
    assert sorted(map(repr, got.where("sponsored").drop("sponsored").select(cells.columns).collect())) == sorted(map(repr, cells.collect()))
    assert cells.count() > 5 and cards.count() > 20
