"""Order books over payloads and level tables derived from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.operators import books
from oddslake.plans.registry import Query, json_text, spread_table, table, text

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Kalshi book per row; by ``l_suppkey % 5`` in dollars, legacy cents, with an invalid
    price, with a missing NO side, or without an enclosing key."""
    bid, bid2 = F.round(F.col("l_tax") * 10, 1), F.round(F.col("l_tax") * 5, 2)
    no = F.round(1 - F.col("l_discount") * 10, 1)
    level = lambda p, s: F.concat(F.lit('["'), p.cast("string"), F.lit('","'), s.cast("string"), F.lit('"]'))
    listed = lambda *ls: F.concat(F.lit("["), F.concat_ws(",", *ls), F.lit("]"))
    yes_levels = listed(level(bid2, F.col("l_linenumber") - 1), level(bid, F.col("l_quantity")))
    no_levels = listed(level(no, F.col("l_quantity")), level(F.lit("0"), F.col("l_linenumber")))
    cents = lambda p: F.round(p * 100, 0).cast("int")
    shape = F.col("l_suppkey") % 5
    dollars = json_text(yes_dollars=yes_levels, no_dollars=no_levels)
    data = (
        F.when(shape == 0, json_text(orderbook_fp=dollars))
        .when(shape == 1, json_text(orderbook=json_text(yes=listed(level(cents(bid), F.col("l_quantity"))), no=listed(level(cents(no), F.col("l_quantity"))))))
        .when(shape == 2, json_text(orderbook_fp=json_text(yes_dollars=listed(level(F.lit("NaN"), F.lit("1"))), no_dollars=no_levels)))
        .when(shape == 3, json_text(orderbook_fp=json_text(yes_dollars=yes_levels, no_dollars=F.lit("null"))))
        .otherwise(dollars)
    )
    return spread_table(spark, sf_dir, "lineitem").select(*KEYS, data.alias("data"))


SIDES = """
WITH base AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 5 AS shape, CAST(l_quantity AS DECIMAL(10,2)) AS q,
    CAST(round(l_tax * 10, 1) AS DECIMAL(6,2)) AS b, CAST(round(l_tax * 5, 2) AS DECIMAL(6,2)) AS b2,
    CAST(round(1 - l_discount * 10, 1) AS DECIMAL(6,2)) AS n FROM lineitem),
levels AS (
  SELECT *, 'bid' AS side, b AS price, q AS size FROM base WHERE shape <> 2
  UNION ALL SELECT *, 'bid', b2, l_linenumber - 1 FROM base WHERE shape IN (0, 3, 4) AND l_linenumber > 1
  UNION ALL SELECT *, 'ask', 1 - n, q FROM base WHERE shape IN (0, 1, 4)
  UNION ALL SELECT *, 'ask', CAST(1 AS DECIMAL(6,2)), l_linenumber FROM base WHERE shape IN (0, 4))"""
AS_DOUBLE = ["best_bid", "best_ask", "spread", "midpoint"]


def touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books.yes_book(payloads(spark, sf_dir))
    return rows.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in AS_DOUBLE], "crossed", "book_error")


def yes_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every level with its place in the sorted ladder of its book."""
    rows = books.yes_book(payloads(spark, sf_dir)).filter(F.col("book_error").isNull())
    tag = lambda c, s: F.transform(c, lambda x, i: F.struct(F.lit(s).alias("side"), (i + 1).alias("place"), x["price"].alias("price"), x["size"].alias("size")))
    level = F.explode(F.concat(tag("yes_bids", "bid"), tag("yes_asks", "ask"))).alias("l")
    return rows.select(*KEYS, level).select(
        *KEYS, "l.side", "l.place", F.col("l.price").cast("double").alias("price"), F.col("l.size").cast("double").alias("size")
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        text("l_orderkey").alias("market"),
        F.when(F.col("l_linestatus") == "O", "bids").otherwise("asks").alias("side"),
        F.round(F.col("l_discount") * 10, 1).cast("decimal(10,4)").alias("price"),
        F.col("l_quantity").cast("decimal(18,4)").alias("size"),
    )


def market_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books.book_touch(levels(spark, sf_dir), ["market"])
    return rows.select("market", *[F.col(c).cast("double").alias(c) for c in AS_DOUBLE], "crossed")


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polymarket payloads exploded to levels, then in ladder order."""
    price = lambda c: F.round(F.col(c) * 10, 1).cast("string")
    one = lambda p: F.concat(F.lit('[{"price":"'), p, F.lit('","size":"'), text("l_quantity"), F.lit('"}]'))
    asks = F.when(F.col("l_linenumber") == 2, F.lit("[]")).otherwise(one(price("l_discount")))
    data = json_text(asset_id=F.concat(F.lit('"'), text("l_orderkey"), F.lit('"')), bids=one(price("l_tax")), asks=asks)
    rows = spread_table(spark, sf_dir, "lineitem").select("l_linenumber", data.alias("data"))
    return books.ladder(books.clob_levels(rows), ["token_id"]).select(
        "token_id", "l_linenumber", "side", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size")
    )


QUERIES = [
    Query(
        "yes_book_touch",
        touch,
        SIDES + """, t AS (SELECT *, CASE WHEN l_linenumber > 1 AND shape IN (0, 3, 4) THEN greatest(b, b2) ELSE b END AS bb,
            CASE WHEN shape IN (0, 1, 4) THEN 1 - n END AS ba FROM base WHERE shape <> 2)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(bb AS DOUBLE) AS best_bid, CAST(ba AS DOUBLE) AS best_ask,
          CAST(ba - bb AS DOUBLE) AS spread, CAST(ba + bb AS DOUBLE) / 2 AS midpoint, coalesce(ba < bb, false) AS crossed, NULL AS book_error FROM t
        UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NULL, NULL, NULL, NULL, false, 'invalid price or quantity' FROM base WHERE shape = 2""",
    ),
    Query(
        "yes_book_ladder",
        yes_ladder,
        SIDES.replace("FROM lineitem)", ", row_number() OVER () AS id FROM lineitem)") + """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, side,
          row_number() OVER (PARTITION BY id, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, CASE WHEN side = 'bid' THEN -size ELSE size END) AS place,
          CAST(price AS DOUBLE) AS price, CAST(size AS DOUBLE) AS size FROM levels""",
    ),
    Query(
        "market_book_touch",
        market_touch,
        """SELECT market, bb AS best_bid, ba AS best_ask, CAST(CAST(ba AS DECIMAL(6,2)) - CAST(bb AS DECIMAL(6,2)) AS DOUBLE) AS spread,
          CAST(CAST(ba AS DECIMAL(6,2)) + CAST(bb AS DECIMAL(6,2)) AS DOUBLE) / 2 AS midpoint, coalesce(bb > ba, false) AS crossed
        FROM (SELECT CAST(l_orderkey AS VARCHAR) AS market, max(round(l_discount * 10, 1)) FILTER (l_linestatus = 'O') AS bb,
          min(round(l_discount * 10, 1)) FILTER (l_linestatus <> 'O') AS ba FROM lineitem GROUP BY 1)""",
    ),
    Query(
        "clob_book_levels",
        exploded,
        """SELECT CAST(l_orderkey AS VARCHAR) AS token_id, l_linenumber, 'bids' AS side, round(l_tax * 10, 1) AS price, l_quantity AS size FROM lineitem
        UNION ALL SELECT CAST(l_orderkey AS VARCHAR), l_linenumber, 'asks', round(l_discount * 10, 1), l_quantity FROM lineitem WHERE l_linenumber <> 2""",
    ),
]
