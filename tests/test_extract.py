from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.sources import extract


def test_embedded_json(spark):
    page = '<script>{"marketplace_listing_title":"Sofa \\u00e9","redacted_description":{"text":"Line\\nTwo"},"formatted_amount":"$5","is_sold":true}</script>'
    df = spark.createDataFrame([("1", page), ("2", "<p>none"), ("3", None)], "item_id string, html string")
    got = {r["item_id"]: r for r in extract.embedded_listing(df).collect()}
    assert got["1"]["found"] and got["1"]["title"] == "Sofa é" and got["1"]["price_text"] == "$5 · sold" and got["1"]["text_lines"] == ["$5 · sold", "Sofa é", "Line", "Two"]
    assert not got["2"]["found"] and not got["3"]["found"]


def test_links(spark):
    page = '<a href="https://l.facebook.com/l.php?u=https%3A%2F%2Fa.example%2Fx&amp;h=1">a</a><a href="/r">b</a><a href="https://b.example/">c</a><a href="https://b.example/">c</a>'
    assert spark.createDataFrame([(page,)], "h string").select(extract.outbound_links(F.col("h"))).first()[0] == ["https://a.example/x", "https://b.example/"]


def test_card(spark):
    df = spark.createDataFrame([(["$20", "Oak desk, 2 drawers in Bend, OR", "Bend, OR", "Sold by Ann Lee"], "Marketplace: Oak desk, 2 drawers in Bend, OR")], "text_lines array<string>, label string")
    r = extract.card_columns(df, label="label").first()
    assert (r["price_text"], r["location_text"], r["title"], r["seller_text"]) == ("$20", "Bend, OR", "Oak desk, 2 drawers", "Sold by Ann Lee")


def test_redact_and_terms(spark):
    r = spark.range(1).select(T.redact(F.lit("mail a.b@c.org or 415-555-2671 now")).alias("x"), T.allow_term(F.lit("the new oak table")).alias("y"), T.allow_term(F.lit("the new")).alias("z")).first()
    assert r["x"] == "mail [email] or [phone] now" and r["y"] == "the new oak table" and r["z"] is None


RELATED = '<div><a href="/marketplace/item/77/">Other chair $5</a></div>'
PAGE = (
    '<html><body><nav>Home</nav><div role="main"><h1>Notices</h1><div><div><h1>Oak &amp; ash desk</h1><span>$120</span><span>$120</span>'
    '<p>Listed 2 days ago in Bend, OR</p><p>Two drawers<br>some wear</p><a href="https://l.facebook.com/l.php?u=https%3A%2F%2Fshop.example%2Fd&amp;h=1">more</a></div></div>'
    f'<img src="https://img.example/1.jpg">{RELATED}</div><aside>$3 socks</aside></body></html>'
)


def test_detail_container(spark):
    pages = [
        (1, PAGE), (2, PAGE.replace(RELATED, "<div><a href='/ads/about?x=1'>Ad</a> $4 socks</div>")), (3, "<h1>No main part</h1>"), (4, None), (5, ""), (6, PAGE.replace(RELATED, "")),
        (7, PAGE.replace("<body>", '<body><div role="dialog"><h1>Lamp</h1><p>Free</p></div>')),
    ]
    df = spark.createDataFrame([(i, f"https://www.facebook.com/marketplace/item/{i}/", h) for i, h in pages], "n int, url string, html string")
    got = {r["n"]: r for r in extract.detail_columns(df).collect()}
    for i in (1, 2):
        r = got[i]
        assert (r["title"], r["price_text"], r["location_text"], r["item_id"], r["image_url"]) == ("Oak & ash desk", "$120", "Bend, OR", str(i), "https://img.example/1.jpg")
        assert r["text_lines"] == ["Oak & ash desk", "$120", "Listed 2 days ago in Bend, OR", "Two drawers", "some wear", "more", "https://shop.example/d"]
    assert [(got[i]["found"], got[i]["title"], got[i]["text_lines"]) for i in (3, 4, 5)] == [(False, "", [])] * 3
    assert got[6]["text_lines"][0] == "Notices" and got[6]["title"] == "Oak & ash desk"
    assert got[7]["text_lines"] == ["Lamp", "Free"] and got[7]["price_text"] == "Free"


def test_fetched_listing(spark):
    json = '<script>{"marketplace_listing_title":"Pine shelf","redacted_description":{"text":"solid\\nold"},"formatted_amount":"$9"}</script>'
    df = spark.createDataFrame([("1", json + PAGE), ("2", PAGE), ("3", "<p>shell</p>"), ("4", '<div role="main"><h1>Lamp</h1></div>'), ("5", None)], "item_id string, html string")
    got = {r["item_id"]: r for r in extract.fetched_listing(df).collect()}
    assert got["1"]["title"] == "Pine shelf" and got["2"]["title"] == "Oak & ash desk" and got["2"]["url"].endswith("/item/2/")
    assert {i: r["found"] for i, r in got.items()} == {"1": True, "2": True, "3": False, "4": False, "5": False} and got["4"]["title"] is None


def test_labels_join_a_card(spark):
    df = spark.createDataFrame([(["$20", "Oak desk"], ["View in 3D", "$20"]), (["$20", "Oak desk"], None)], "text_lines array<string>, labels array<string>")
    a, b = extract.card_columns(df, labels="labels").collect()
    assert a["text_lines"] == ["$20", "Oak desk", "View in 3D"] and a["visible_text"].endswith("View in 3D") and a["title"] == "Oak desk"
    assert b["text_lines"] == ["$20", "Oak desk"] and b["visible_text"] == "$20 Oak desk"
