"""Trades, candles, price points, holders and details: typing, merging, archive routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddslake import schemas
from oddslake.functions import computed, fingerprint, instant, latest_by, number, salted_join, truthy

VENUES = ["polymarket", "kalshi"]


def merge_latest(
    live: DataFrame,
    archive: DataFrame,
    keys: Sequence[str],
    pos: str = "row_pos",
    keep: str = "last",
) -> DataFrame:
    """Union of both tiers with one row per key; archive rows count as later than live rows.

    ``first_tier`` and ``first_pos`` tell where a key was first seen, which is its place in the
    merged order.
    """
    both = live.withColumn("tier_rank", F.lit(0)).unionByName(
        archive.withColumn("tier_rank", F.lit(1)), allowMissingColumns=True
    )
    order = F.struct(F.col("tier_rank"), F.col(pos))
    merged = latest_by(both, keys, order, keep, first_pos="__first")
    return (
        merged.withColumn("first_tier", F.col("__first.tier_rank"))
        .withColumn("first_pos", F.col("__first")[pos])
        .drop("__first", "tier_rank")
    )


def trade_key(trade_id: Column, raw: Column) -> Column:
    """Trade id, or the fingerprint of the whole record where it has none."""
    return F.coalesce(truthy(trade_id), fingerprint(raw))


def kalshi_trades(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Typed Kalshi prints with the key used to merge live and archived trades."""
    t = F.from_json(payload, schemas.KALSHI_TRADE)
    keep = [c for c in rows.columns if c != payload]
    return computed(rows, t=t).select(
        *keep,
        trade_key(F.col("t.trade_id"), F.col(payload)).alias("trade_key"),
        "t.trade_id",
        "t.ticker",
        instant(F.col("t.created_time")).alias("time_utc"),
        number(F.col("t.yes_price_dollars")).alias("price"),
        number(F.col("t.count_fp")).alias("size"),
        F.col("t.taker_outcome_side").alias("outcome_side"),
        F.col("t.taker_book_side").alias("book_side"),
    )


def polymarket_trades(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Typed Polymarket prints; ``timestamp`` is epoch seconds."""
    keep = [c for c in rows.columns if c != payload]
    return computed(rows, t=F.from_json(payload, schemas.POLYMARKET_TRADE)).select(
        *keep,
        F.col("t.conditionId").alias("condition_id"),
        F.col("t.asset").alias("token_id"),
        F.timestamp_seconds("t.timestamp").alias("time_utc"),
        "t.outcome",
        "t.side",
        number(F.col("t.price")).alias("price"),
        number(F.col("t.size")).alias("size"),
        F.col("t.transactionHash").alias("transaction_hash"),
    )


def price_points(history: DataFrame, payload: str = "payload") -> DataFrame:
    """Explode sampled price histories: one row per (token_id, t, p)."""
    points = F.from_json(payload, "history ARRAY<STRUCT<t:BIGINT,p:DOUBLE>>")["history"]
    keep = [c for c in history.columns if c != payload]
    return history.select(*keep, F.posexplode(points).alias("point_pos", "point")).select(
        *keep, "point_pos", "point.t", "point.p", F.timestamp_seconds("point.t").alias("time_utc")
    )


def dedupe_points(points: DataFrame, keys: Sequence[str] = ("token_id", "t"), pos: str = "row_pos") -> DataFrame:
    """One sample per token and second; overlapping windows repeat points, the last one wins."""
    return latest_by(points, keys, F.col(pos), "last")


def in_time_order(rows: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows ordered by key and time: ranges of both are dealt out, so a long key has many tasks."""
    return rows.orderBy(*keys, time)


def candles(rows: DataFrame, tier: str, payload: str = "payload") -> DataFrame:
    """Flatten candles of either tier; archived closes are already dollars, gaps stay null."""
    keep = [c for c in rows.columns if c != payload]
    side = lambda s, f: number(F.coalesce(F.col(f"c.{s}.{f}_dollars"), F.col(f"c.{s}.{f}")))
    return computed(rows, c=F.from_json(payload, schemas.CANDLE)).select(
        *keep,
        F.lit(tier).alias("tier"),
        "c.end_period_ts",
        F.timestamp_seconds("c.end_period_ts").alias("time_utc"),
        *[side("price", f).alias(f"trade_{f}") for f in ("open", "high", "low", "close")],
        side("yes_bid", "close").alias("bid_close"),
        side("yes_ask", "close").alias("ask_close"),
        number(F.coalesce("c.volume_fp", "c.volume")).alias("volume"),
        number(F.coalesce("c.open_interest_fp", "c.open_interest")).alias("open_interest"),
    )


def dedupe_candles(
    rows: DataFrame, keys: Sequence[str] = ("ticker",), pos: str = "row_pos", keep: str = "last"
) -> DataFrame:
    """One candle per end stamp. ``keep='first'`` also retains every row without a stamp."""
    stamped = latest_by(rows.filter(F.col("end_period_ts").isNotNull()), [*keys, "end_period_ts"], F.col(pos), keep)
    if keep == "last":
        return stamped
    return stamped.unionByName(rows.filter(F.col("end_period_ts").isNull()))


#: Windows that one word of a bitmap holds; one bit more would overflow when it is full.
_WORD = 62


def _first_gap(windows: DataFrame, archived: DataFrame) -> DataFrame:
    """``switch_index`` of each archived market: its lowest window without a live candle.

    The windows of a market are bits of a few words, so they are collected on the map side.
    """
    word = lambda place, bits, listed: F.struct(place.alias("place"), bits.alias("bits"), F.lit(listed).alias("listed"))
    index = F.col("window_index")
    marks = windows.select("ticker", word(F.floor(index / _WORD), F.call_function("shiftleft", F.lit(1).cast("bigint"), (index % _WORD).cast("int")), False).alias("w"))
    marks = marks.unionByName(archived.select("ticker", word(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), True).alias("w")))
    words = marks.groupBy("ticker", F.col("w.place").alias("place")).agg(F.bit_or("w.bits").alias("bits"), F.bool_or("w.listed").alias("listed"))
    # A market has one word for every 62 windows of the range.
    held = words.groupBy("ticker").agg(F.bool_or("listed").alias("listed"), F.array_sort(F.collect_list(F.struct("place", "bits"))).alias("words"))
    full = (1 << _WORD) - 1
    lowest = lambda bits: F.length(F.bin((bits + 1).bitwiseAND(F.lit(full + 1) + F.lit(full) - bits))) - 1

    def add(reached: Column, w: Column) -> Column:
        return F.when(reached == w["place"] * _WORD, reached + F.when(w["bits"] == full, F.lit(_WORD)).otherwise(lowest(w["bits"]))).otherwise(reached)

    return held.filter("listed").select("ticker", F.aggregate("words", F.lit(0).cast("bigint"), add).alias("switch_index"))


def route_candles(
    live: DataFrame,
    archive: DataFrame,
    archived_markets: DataFrame,
    start: int,
    end: int,
    step: int,
    pos: str = "row_pos",
) -> DataFrame:
    """Candles of [start, end] read window by window from the live tier, moving to the archive.

    The first window in which an archived market has no live candle switches that market to
    the archive for this and all later windows. A candle on a window border belongs to both
    windows, and the later window wins.
    """
    last_index = (end - start - 1) // step
    offset = F.col("end_period_ts") - F.lit(start)
    index = F.floor(offset / F.lit(step))
    on_border = (offset % F.lit(step) == 0) & (offset > 0)
    windows = F.filter(
        F.when(on_border, F.array(index - 1, index)).otherwise(F.array(index)),
        lambda i: (i >= 0) & (i <= F.lit(last_index)),
    )
    ranged = lambda df: df.filter(F.col("end_period_ts").between(start, end)).withColumn(
        "window_index", F.explode(windows)
    )
    switch = _first_gap(ranged(live).select("ticker", "window_index"), archived_markets.select("ticker"))
    tiers = ranged(live).withColumn("tier", F.lit("live")).unionByName(ranged(archive).withColumn("tier", F.lit("archive")), allowMissingColumns=True)
    # A market may hold a large part of all candles, so its rows are spread by their time.
    placed = salted_join(tiers, switch, ["ticker"], F.col("end_period_ts"), "left")
    from_live = F.col("switch_index").isNull() | (F.col("window_index") < F.col("switch_index"))
    routed = placed.filter(F.when(F.col("tier") == "live", from_live).otherwise(F.col("window_index") >= F.col("switch_index")))
    order = F.struct(F.col("window_index"), F.col(pos))
    return latest_by(routed, ["ticker", "end_period_ts"], order, "last").drop("window_index", "switch_index")


def trade_tiers(ranges: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Which trade tiers a range needs: the archive too when it starts before the cutoff.

    Cutoffs are reduced to the known venues, one row each, which bounds the broadcast.
    """
    bounds = (
        cutoffs.filter(F.col("platform").isin(*VENUES))
        .groupBy("platform")
        .agg(F.max(F.unix_seconds(instant(F.col("trades_created_ts")))).alias("cutoff"))
    )
    return (
        ranges.join(F.broadcast(bounds), "platform", "left")
        .withColumn("reads_archive", F.coalesce(F.col("start_ts") < F.col("cutoff"), F.lit(False)))
        .withColumn("tiers", F.when(F.col("reads_archive"), F.lit("live+archive")).otherwise(F.lit("live")))
    )


def holders(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per holder with the outcome token it belongs to."""
    keep = [c for c in rows.columns if c != payload]
    return (
        computed(rows, g=F.from_json(payload, schemas.HOLDER_GROUP))
        .select(*keep, F.col("g.token").alias("token"), F.explode("g.holders").alias("h"))
        .select(
            *keep,
            "token",
            F.col("h.proxyWallet").alias("wallet"),
            number(F.col("h.amount")).alias("amount"),
            F.col("h.outcomeIndex").alias("outcome_index"),
        )
    )


def market_details(contracts: DataFrame, live: DataFrame, archived: DataFrame, key: str = "ticker") -> DataFrame:
    """Contract details from the live table, else from the archive; both sides unique per key."""
    a = live.select(key, F.col("payload").alias("__live"))
    b = archived.select(key, F.col("payload").alias("__archived"))
    return (
        contracts.join(a, key, "left")
        .join(b, key, "left")
        .withColumn("details", F.coalesce("__live", "__archived"))
        .withColumn(
            "details_tier",
            F.when(F.col("__live").isNotNull(), "live").when(F.col("__archived").isNotNull(), "archive"),
        )
        .drop("__live", "__archived")
    )
