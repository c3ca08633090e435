"""Order books: level tables, ladders and the touch, in exact decimals.

A book payload is one row and stays one row while its levels are checked and sorted with
array functions. Level tables that arrive exploded are only ever reduced with max and min.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.functions import computed

PRICE, SIZE, SCALE = "decimal(18,10)", "decimal(28,10)", "decimal(3,2)"
LEVELS = "ARRAY<ARRAY<STRING>>"
_BOOK = f"yes_dollars {LEVELS}, no_dollars {LEVELS}, yes {LEVELS}, no {LEVELS}"
_CLOB = "asset_id STRING, market STRING, bids ARRAY<STRUCT<price:STRING,size:STRING>>, asks ARRAY<STRUCT<price:STRING,size:STRING>>"
# Fixed value: a finite decimal written as text.
DECIMAL_TEXT = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def _decimal(text: Column, kind: str) -> Column:
    return F.when(text.rlike(DECIMAL_TEXT), F.trim(text).try_cast(kind))


def _levels(raw: Column, scale: Column) -> Column:
    """Parsed levels of a side. Nothing inside a lambda is shared, so each text is parsed in a step of its own."""
    parsed = F.transform(
        raw,
        lambda level: F.struct((_decimal(F.get(level, 0), PRICE) * scale).cast(PRICE).alias("price"), _decimal(F.get(level, 1), SIZE).alias("size")),
    )
    ok = lambda x: F.coalesce(x["price"].between(0, 1) & (x["size"] >= 0), F.lit(False))
    return F.transform(parsed, lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"), ok(x).alias("ok")))


def yes_book(books: DataFrame, payload: str = "data", strict: bool = False) -> DataFrame:
    """Add the YES view of each Kalshi book: sorted ``yes_bids`` and ``yes_asks``, touch,
    spread, midpoint and ``crossed``.

    A NO bid at x is a YES ask at 1 - x of the same size; levels of size zero are dropped. A
    malformed level marks the row with ``book_error`` and leaves its quotes null, or stops the
    job in ``strict`` mode.
    """
    raw = F.col(payload)
    inner = F.coalesce(
        F.nullif(F.get_json_object(raw, "$.orderbook_fp"), F.lit("{}")),
        F.nullif(F.get_json_object(raw, "$.orderbook"), F.lit("{}")),
        raw,
    )
    opened = computed(books, __inner=inner)
    parsed = computed(
        opened,
        __book=F.from_json("__inner", _BOOK),
        __keys=F.coalesce(F.json_object_keys("__inner"), F.array().cast("array<string>")),
    )
    book, keys = F.col("__book"), F.col("__keys")
    sides = {}
    for side in ("yes", "no"):
        dollars = F.array_contains(keys, f"{side}_dollars")
        raw_levels = F.when(dollars, book[f"{side}_dollars"]).otherwise(book[side])
        sides[f"__raw_{side}"] = F.coalesce(raw_levels, F.array().cast(LEVELS))
        sides[f"__scale_{side}"] = F.when(dollars, F.lit("1").cast(SCALE)).otherwise(F.lit("0.01").cast(SCALE))
    told = computed(parsed, **sides).drop("__keys")
    leveled = computed(told, **{f"__{side}": _levels(F.col(f"__raw_{side}"), F.col(f"__scale_{side}")) for side in ("yes", "no")})
    bad = F.col("__book").isNull() | F.exists("__yes", lambda x: ~x["ok"]) | F.exists("__no", lambda x: ~x["ok"])
    error = F.when(F.col("__book").isNull(), F.lit("book is not an object")).when(
        bad, F.lit("invalid price or quantity")
    )
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    kept = lambda side: F.filter(side, lambda x: x["size"] > 0)
    pair = lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"))
    flip = lambda x: F.struct(
        (F.lit(1).cast(PRICE) - x["price"]).cast(PRICE).alias("price"), x["size"].alias("size")
    )
    ladders = computed(
        leveled,
        book_error=error,
        yes_bids=F.when(~bad, F.sort_array(F.transform(kept("__yes"), pair), asc=False)),
        yes_asks=F.when(~bad, F.sort_array(F.transform(kept("__no"), flip))),
    )
    bid, ask = F.get("yes_bids", 0)["price"], F.get("yes_asks", 0)["price"]
    return ladders.select(
        *books.columns,
        "book_error",
        "yes_bids",
        "yes_asks",
        bid.alias("best_bid"),
        ask.alias("best_ask"),
        (ask - bid).cast(PRICE).alias("spread"),
        ((ask + bid) * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(20,12)").alias("midpoint"),
        F.coalesce(ask < bid, F.lit(False)).alias("crossed"),
    )


def clob_levels(books: DataFrame, payload: str = "data") -> DataFrame:
    """Polymarket books exploded to one row per level with its ``side``."""
    book = F.from_json(payload, _CLOB)
    keep = [c for c in books.columns if c != payload]

    def tagged(side: str) -> Column:
        level = lambda x: F.struct(
            F.lit(side).alias("side"),
            _decimal(x["price"], PRICE).alias("price"),
            _decimal(x["size"], SIZE).alias("size"),
        )
        return F.transform(F.coalesce(F.col(f"b.{side}"), F.array().cast("array<struct<price:string,size:string>>")), level)

    return (
        computed(books, b=book)
        .select(*keep, F.col("b.asset_id").alias("token_id"), F.explode(F.concat(tagged("bids"), tagged("asks"))).alias("l"))
        .select(*keep, "token_id", "l.side", "l.price", "l.size")
    )


def ladder(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Level rows in ladder order: bids from the best price down, asks from the best up.

    A range sort, so a deep book spreads over tasks instead of being gathered.
    """
    down = F.col("side") == "bids"
    signed = lambda c: F.when(down, -F.col(c)).otherwise(F.col(c))
    return levels.orderBy(*keys, F.when(down, 0).otherwise(1), signed("price"), signed("size"))


def book_touch(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best bid, best ask, spread, midpoint and ``crossed`` per book; an empty side stays null."""
    bid = F.max(F.when(F.col("side") == "bids", F.col("price"))).alias("best_bid")
    ask = F.min(F.when(F.col("side") == "asks", F.col("price"))).alias("best_ask")
    touch = levels.groupBy(*keys).agg(bid, ask)
    return touch.select(
        "*",
        (F.col("best_ask") - F.col("best_bid")).alias("spread"),
        ((F.col("best_ask") + F.col("best_bid")) * F.lit("0.5").cast("decimal(2,1)")).alias("midpoint"),
        F.coalesce(F.col("best_bid") > F.col("best_ask"), F.lit(False)).alias("crossed"),
    )
