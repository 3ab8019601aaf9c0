"""Listings made from the star-schema tables: one SQL text that Spark and other engines read alike.

A listing is a line item: its page is a run of orders, its place on the page the order of its number, its
texts phrases of a small dictionary picked by its keys, so that every rule has listings that it hits
and listings that it passes over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = [
    "Solid oak dresser with mirror", "Brand new air fryer in box", "ISO vintage road bike", "Wanted: old vinyl records", "Sold pending pickup desk lamp",
    "Gucci Chanel Prada bag", "Louis Vuitton wallet", "Air Jordan 4 sneakers", "IKEA Kallax shelf", "Amazon Echo speaker", "Amazon returns lot chair",
    "sofa couch sectional loveseat recliner chair table desk", "Queen mattress never used", "Lamy fine nib pen", "Hand carved walnut chair", "Looking for a new home for cat tree",
    "Chairs sold separately patio set", "Dining table , four chairs , bench | lamp | rug , art , pots , pans | mugs , bowls", "temu wish amazon walmart gadget",
    "Garden bench", "Wanted movie poster framed", "bed bed bed bed bed bed frame frame frame frame frame frame bed bed", "Treadmill works great", "Kids stroller", "Wool rug 5x8",
    "Rolex watch", "Moving sale everything must go", "Reserved for Anna crib", "Teak sideboard", "Steel nib fountain pen",
]
BODIES = [
    "gently used and clean", "ships from our warehouse", "temu order arrived twice", "found on ali express", "alibaba lot", "dhgate special", "banggood parts", "shein haul dress",
    "seen on tiktok shop", "ordered from wish", "shopify storefront", "amazon fire tablet", "bought on amazon last year", "from ikea in 2019", "wayfair clearance", "overstock item",
    "walmart bike", "from target last fall", "costco sized", "sams club table", "home depot paint", "lowes tiles", "ashley furniture set", "rooms to go sofa", "saw it on ebay",
    "mercari cross post", "poshmark closet", "replica quality", "model 1:1 scale ship", "designer dupe bag", "available in multiple colors", "order now while supplies last",
    "wholesale pricing", "view in 3d", "more in stock", "visit our store at the showroom", "no dealer please", "dealer fees apply", "no dealer fees", "liquidation pallets available",
    "inventory in stock tax included", "call today or text me to buy", "we finance bad credit", "plus tax title license", "see https://deals.example/x", "visit mystuff.com soon",
    "amazon.com/dp/B01234", "message me on whatsapp", "promo code SAVE", "call me at 415-555-2671", "instagram @shop_here", "does anyone have one", "trade only please",
    "junk removal and dump runs", "free estimates licensed and insured", "apartment for rent", "work from home job available", "passive income side hustle", "join our team today",
    "deposit required to hold", "zelle only", "shipping only", "payment is pending until release funds", "i am out of town, my agent will meet you", "send the six digit code",
    "bitcoin only", "guaranteed returns on crypto signals", "overpaid by mistake refund the difference", "perfect for any room", "sku 12345 upc", "assembly required, weight capacity 300",
    "stock photo for reference only", "estate sale, downsizing", "works with remote", "works fine, minor scratches", "solid oak, mid-century", "looks real, box and papers",
    "authenticity unknown", "real price in description $250", "read description, price varies", "$15 each or $90 for all", "smoke free home, pickup only", "brand new sealed, stock order",
    "condition new, never worn", "deadstock in box", "listed by Downtown Motors", "", "plain and simple",
]
PRICES = ["$20", "Free", "$1", "$1,234", "£40", "", "Contact for price", "$123", "$45", "$450", "CA$ 80", "$5", "$99.50", "ask for price", "sold"]


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: The keys that a listing's texts are picked by, one row a line.
_KEYS = """
      SELECT item_no, page_id, ln, pk, sk, s_name, n_name FROM (
        SELECT l_orderkey * 10 + l_linenumber AS item_no, CAST(FLOOR(l_orderkey / 32) AS BIGINT) AS page_id, l_linenumber AS ln, MIN(l_partkey) AS pk, MIN(l_suppkey) AS sk
        FROM lineitem GROUP BY l_orderkey, l_linenumber
      ) u JOIN supplier ON sk = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""


def _kinds_sql(keys: str) -> str:
    """What a listing's texts follow from, one row a line."""
    flood = "page_id % 5 = 0"
    t = f"CASE WHEN {flood} THEN ln % 3 ELSE pk % {len(TITLES)} END"
    return f"""
    SELECT item_no, page_id, {t} AS t, CASE WHEN {flood} THEN (ln % 2) * 2 ELSE (pk + ln) % {len(PRICES)} END AS p,
      CASE WHEN {flood} THEN 0 ELSE (pk * 7 + ln * 3 + sk) % {len(BODIES)} END AS b,
      CONCAT(CASE WHEN {flood} THEN 'Lake City' ELSE n_name END, ', ', CASE ln % 3 WHEN 0 THEN 'WA' WHEN 1 THEN 'OR' ELSE 'ID' END) AS location_text,
      CASE WHEN sk % 4 = 0 THEN s_name ELSE '' END AS seller_text, pk % 11 = 0 AS sponsored, page_id % 7 = 0 AS profile,
      CASE pk % 3 WHEN 0 THEN 'legit' WHEN 1 THEN 'slop' ELSE 'borderline' END AS label
    FROM ({keys}    ) k"""


_TITLE, _PRICE, _BODY = _case("t", TITLES), _case("p", PRICES), _case("b", BODIES)
_SHOWN = "CONCAT_WS(' ', title, price_text, location_text, body, CASE WHEN sponsored THEN 'Sponsored' END) AS visible_text"
_URL = "CONCAT('https://www.facebook.com/marketplace/item/', CAST(item_no AS STRING), '/?ref=search#top') AS url"


def listings_sql(keys: str = _KEYS) -> str:
    """The listing view over lineitem, part, supplier and nation."""
    return f"""
SELECT item_no, CAST(item_no AS STRING) AS item_id, page_id, item_no AS pos,
  {_URL},
  title, price_text, location_text, seller_text, body, 
  {_SHOWN},
  sponsored, profile, label
FROM (
  SELECT item_no, page_id, {_TITLE} AS title,
    {_PRICE} AS price_text, location_text, seller_text, {_BODY} AS body, sponsored, profile, label
  FROM ({_kinds_sql(keys)}
  ) k2
) k3
"""


def _keys(spark: SparkSession, sf_dir: str) -> None:
    """The view ``listing_keys``."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # keys are dealt by page, which is how flood windows want them, before they become texts: they are far narrower, and one exchange serves
    # the grouping too. Scoring is heavy for each byte, so small inputs take all cores
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = read("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(FLOOR(l_orderkey / 32) AS BIGINT) AS page_id").repartition(n, "page_id")
    one = lines.groupBy("page_id", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"))
    keys = one.join(read("supplier"), F.col("sk") == F.col("s_suppkey")).join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    keys.selectExpr("l_orderkey * 10 + l_linenumber AS item_no", "page_id", "l_linenumber AS ln", "pk", "sk", "s_name", "n_name").createOrReplaceTempView("listing_keys")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _keys(spark, sf_dir)
    return spark.sql(listings_sql("SELECT * FROM listing_keys"))


#: Listings that agree in these have the same texts: they are of one kind.
KIND = ("t", "p", "b", "location_text", "seller_text", "sponsored")


def kinds_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings with their kinds instead of texts: far narrower, and there are far fewer kinds than listings in large tables."""
    _keys(spark, sf_dir)
    rows = spark.sql(_kinds_sql("SELECT * FROM listing_keys"))
    return rows.selectExpr("*", "CAST(item_no AS STRING) AS item_id", "item_no AS pos", _URL)


def texts_of(kinds: DataFrame) -> DataFrame:
    """The texts of rows that have the columns of a kind."""
    return kinds.selectExpr("*", f"{_TITLE} AS title", f"{_PRICE} AS price_text", f"{_BODY} AS body").selectExpr("*", _SHOWN)


def by_kind(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with what is ``known`` of their ``kind`` (a struct), once for each row known of it; rows of other kinds go, columns of both are the known ones."""
    what = [c for c in known.columns if c != "kind"]
    k = known.select(*[F.col(f"kind.{c}").alias(f"_k_{c}") for c in KIND], *[F.col(c).alias(f"_w_{c}") for c in what])
    # one number first, which sorts and deals fast; the columns themselves decide
    mixed = lambda pre: F.xxhash64(*[f"{pre}{c}" for c in KIND])
    same = mixed("") == mixed("_k_")
    for c in KIND:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(k, same).select(*[c for c in rows.columns if c not in what], *[F.col(f"_w_{c}").alias(c) for c in what])
