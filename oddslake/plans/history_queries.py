"""Trades, candles, price points and time windows derived from ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.operators import history, timewindows
from oddslake.plans.registry import Query, epoch, json_text, quoted, table, text
from oddslake.session import stored

DAY = 86400


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("sec", epoch("ts"))


def kalshi_prints(spark: SparkSession, sf_dir: str, archived: bool) -> DataFrame:
    """Trade payloads; every tenth has no id, and the archive writes its keys in another order."""
    rows = events(spark, sf_dir).filter(F.dayofmonth("ts") <= 20 if archived else F.dayofmonth("ts") >= 10)
    at = quoted(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    price = F.round(F.col("value") / (250 if archived else 500), 4)
    ticker = quoted(F.concat(F.lit("U"), text("user_id")))
    known = json_text(trade_id=quoted(text("event_id")), ticker=ticker, created_time=at, yes_price_dollars=quoted(price), count_fp=quoted(F.col("user_id")))
    number_ = F.col("event_id").cast("string")
    anonymous = json_text(count_fp=number_, ticker=ticker) if archived else json_text(ticker=ticker, count_fp=number_)
    payload = F.when(F.col("event_id") % 10 == 0, anonymous).otherwise(known)
    return rows.select(payload.alias("payload"), F.col("event_id").alias("row_pos"))


def trade_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, archive = (history.kalshi_trades(kalshi_prints(spark, sf_dir, a)) for a in (False, True))
    merged = history.merge_latest(live, archive, ["trade_key"])
    return merged.select(
        F.coalesce(F.col("trade_id"), F.concat(F.lit("#"), F.col("size").cast("bigint").cast("string"))).alias("trade"),
        "ticker", "price", "size", F.date_format("time_utc", "yyyy-MM-dd HH:mm:ss").alias("time_utc"), "first_tier", "first_pos",
    )


def typed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = json_text(
        conditionId=quoted(F.concat(F.lit("0x"), text("user_id"))), asset=quoted(text("user_id")), timestamp=text("sec"), outcome=F.lit('"Yes"'),
        side=quoted(F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL")), price=F.when(F.col("event_id") % 7 == 0, F.lit("null")).otherwise(F.col("value").cast("string")),
        size=quoted(F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(text("user_id"))), transactionHash=quoted(F.concat(F.lit("h"), text("event_id"))),
    )
    rows = history.polymarket_trades(events(spark, sf_dir).select(payload.alias("payload")))
    return rows.select("condition_id", "token_id", F.date_format("time_utc", "yyyy-MM-dd HH:mm:ss").alias("time_utc"), "outcome", "side", "price", "size", "transaction_hash")


def point_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples per event: its hour and the next one, so that neighbours overlap."""
    hour = F.floor(F.col("sec") / 3600) * 3600
    point = lambda t, p: json_text(t=t.cast("string"), p=p.cast("string"))
    history_ = F.concat(F.lit("["), point(hour, F.col("value") / 500), F.lit(","), point(hour + 3600, F.col("value")), F.lit("]"))
    return events(spark, sf_dir).select(text("user_id").alias("token_id"), json_text(history=history_).alias("payload"), F.col("event_id").alias("row_pos"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.price_points(point_payloads(spark, sf_dir)).withColumn("row_pos", F.struct("row_pos", "point_pos"))
    return history.dedupe_points(rows).select("token_id", "t", "p", F.date_format("time_utc", "yyyy-MM-dd HH:mm:ss").alias("time_utc"))


def candle_rows(spark: SparkSession, sf_dir: str, archived: bool) -> DataFrame:
    hour = (F.floor(F.col("sec") / 3600) * 3600).cast("string")
    close = F.when(F.col("event_id") % 9 == 0, F.lit("null")).otherwise(quoted(F.col("value") / 500))
    if archived:
        payload = json_text(end_period_ts=hour, price=json_text(close=close), volume=quoted(F.col("value")))
    else:
        payload = json_text(end_period_ts=hour, price=json_text(close_dollars=close, open_dollars=F.lit('"0.5"')), yes_bid=json_text(close_dollars=quoted(F.lit(0.25))), volume_fp=quoted(F.col("user_id")))
    rows = events(spark, sf_dir)
    if not archived:
        rows = rows.filter((F.dayofmonth("ts") <= 15) | (F.col("event_type") == "view"))
    landed = rows.select(text("user_id").alias("ticker"), F.col("event_id").alias("row_pos"), payload.alias("payload"))
    return history.candles(landed, "archive" if archived else "live")


def flat_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = candle_rows(spark, sf_dir, False).unionByName(candle_rows(spark, sf_dir, True))
    return both.select("ticker", "row_pos", "tier", "end_period_ts", "trade_open", "trade_close", "bid_close", "volume")


def candles_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.dedupe_candles(candle_rows(spark, sf_dir, True))
    return rows.select("ticker", "end_period_ts", "row_pos", "trade_close")


def candles_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candle_rows(spark, sf_dir, True).withColumn("end_period_ts", F.when(F.col("row_pos") % 4 > 0, F.col("end_period_ts")))
    return history.dedupe_candles(rows, keep="first").select("ticker", "end_period_ts", "row_pos")


START, STEP = 1704067200, 4 * DAY  # 2024-01-01, four days


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, archive = (candle_rows(spark, sf_dir, a).drop("tier") for a in (False, True))
    markets = table(spark, sf_dir, "events").filter(F.col("value") > 100).select(text("user_id").alias("ticker"))
    rows = history.route_candles(live, archive, markets, START, START + 30 * DAY, STEP)
    return rows.select("ticker", "end_period_ts", "tier", "row_pos", "volume")


def time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last row of each market by their place in the ordered table."""
    rows = table(spark, sf_dir, "events").select(text("user_id").alias("ticker"), "ts", "event_id")
    ordered = stored(history.in_time_order(rows, ["ticker"], "ts").withColumn("place", F.monotonically_increasing_id()))
    by_key = ordered.groupBy("ticker").agg(F.min_by("event_id", "place").alias("first_event"), F.max_by("event_id", "place").alias("last_event"), F.min_by("event_id", "ts").alias("earliest"))
    return by_key.select("ticker", "first_event", "last_event", (F.col("first_event") == F.col("earliest")).alias("in_order"))


def routed_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every market is known to be archived, also those without an archived candle in the range."""
    live, archive = (candle_rows(spark, sf_dir, a).drop("tier") for a in (False, True))
    thin = archive.filter(F.col("end_period_ts") < START + 3 * DAY)
    markets = table(spark, sf_dir, "events").select(text("user_id").alias("ticker"))
    rows = history.route_candles(live, thin, markets, START, START + 30 * DAY, STEP)
    return rows.select("ticker", "end_period_ts", "tier", "row_pos", "volume")


def order_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = epoch("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", start.alias("start_ts"), (start + (F.col("o_custkey") % 20 + 1) * DAY - 1).alias("end_ts"))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = order_ranges(spark, sf_dir).withColumn("platform", F.when(F.col("o_orderkey") % 3 == 0, "polymarket").otherwise("kalshi"))
    venue = F.when(F.col("o_orderkey") % 3 == 0, "polymarket").otherwise("kalshi").alias("platform")
    cutoffs = table(spark, sf_dir, "orders").groupBy(venue).agg(F.max("o_orderdate").alias("m")).select(
        "platform", F.when(F.col("platform") == "kalshi", F.concat(F.date_format(F.col("m") - F.expr("INTERVAL 700 DAYS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("trades_created_ts")
    )
    return history.trade_tiers(ranges, cutoffs).select("o_orderkey", "platform", "tiers")


def holder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda w, a, i: json_text(proxyWallet=quoted(w), amount=a, outcomeIndex=i)
    group = F.concat(
        F.lit("["), one(text("l_suppkey"), text("l_quantity"), F.lit("0")), F.lit(","), one(text("l_orderkey"), quoted(F.col("l_extendedprice")), text("l_linenumber")), F.lit("]")
    )
    payload = json_text(token=quoted(text("l_partkey")), holders=F.when(F.col("l_linenumber") == 3, F.lit("[]")).otherwise(group))
    return history.holders(table(spark, sf_dir, "lineitem").select(payload.alias("payload")))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("ticker", text("o_orderkey"))
    pick = lambda cond, tag: orders.filter(cond).select("ticker", F.concat(F.lit(tag), F.col("o_orderpriority")).alias("payload"))
    rows = history.market_details(orders.select("ticker"), pick(F.col("o_orderstatus") == "O", "live "), pick(F.col("o_orderstatus") != "F", "old "))
    return rows.select("ticker", "details", "details_tier")


def saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", "sec")
    out = timewindows.split_saturated(rows, ["event_type"], "sec", START, START + 40 * DAY, page_size=20, max_offset=60, max_requests=60)
    return out.select("event_type", "window_start", "window_end", "n_rows", "requests", "over_budget", "incomplete")


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_ranges(spark, sf_dir).withColumn("n_tickers", F.col("o_orderkey") % 100 + 1)
    return timewindows.candle_budget(rows, 60).select("o_orderkey", "candle_estimate", "fits")


E_SEC = "CAST(epoch(date_trunc('second', ts)) AS BIGINT)"
E_HOUR = "CAST(epoch(date_trunc('hour', ts)) AS BIGINT)"
RANGES = "ranges AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS s, CAST(epoch(o_orderdate) AS BIGINT) + (o_custkey % 20 + 1) * 86400 - 1 AS e FROM orders)"

ROUTED = f"""WITH a AS (SELECT user_id, {E_HOUR} AS t, event_id, value, event_type FROM events WHERE {E_HOUR} BETWEEN {START} AND {START + 30 * DAY}),
        w AS (SELECT range AS i, {START} + range * {STEP} AS lo, least({START} + (range + 1) * {STEP}, {START + 30 * DAY}) AS hi FROM range(8)),
        live AS (SELECT a.*, i FROM a JOIN w ON t BETWEEN lo AND hi WHERE event_type = 'view' OR event_id IN (SELECT event_id FROM events WHERE day(ts) <= 15)),
        arch AS (SELECT a.*, i FROM a JOIN w ON t BETWEEN lo AND hi{{thin}}),
        users AS (SELECT DISTINCT user_id FROM events {{users}}),
        sw AS (SELECT u.user_id, min(w.i) AS s FROM users u CROSS JOIN w LEFT JOIN (SELECT DISTINCT user_id, i FROM live) l ON l.user_id = u.user_id AND l.i = w.i WHERE l.i IS NULL GROUP BY 1),
        picked AS (SELECT l.user_id, t, i, event_id, CAST(l.user_id AS DOUBLE) AS volume, 'live' AS tier FROM live l LEFT JOIN sw USING (user_id) WHERE s IS NULL OR i < s
          UNION ALL SELECT user_id, t, i, event_id, value, 'archive' FROM arch JOIN sw USING (user_id) WHERE i >= s)
        SELECT CAST(user_id AS VARCHAR) AS ticker, t AS end_period_ts, tier, event_id AS row_pos, volume FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, t ORDER BY i DESC, event_id DESC) AS rn FROM picked) WHERE rn = 1"""

QUERIES = [
    Query(
        "trade_merge_dedupe",
        trade_merge,
        """WITH t AS (SELECT event_id, user_id, ts, value, day(ts) >= 10 AS live, day(ts) <= 20 AS arch FROM events)
        SELECT CASE WHEN event_id % 10 = 0 THEN '#' || CAST(event_id AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS trade, 'U' || CAST(user_id AS VARCHAR) AS ticker,
          CASE WHEN event_id % 10 > 0 THEN CASE WHEN arch THEN round(value / 250, 4) ELSE round(value / 500, 4) END END AS price,
          CAST(CASE WHEN event_id % 10 = 0 THEN event_id ELSE user_id END AS DOUBLE) AS size, CASE WHEN event_id % 10 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time_utc,
          CASE WHEN live THEN 0 ELSE 1 END AS first_tier, event_id AS first_pos FROM t""",
    ),
    Query(
        "trades_typed",
        typed_trades,
        """SELECT '0x' || CAST(user_id AS VARCHAR) AS condition_id, CAST(user_id AS VARCHAR) AS token_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_utc, 'Yes' AS outcome,
          CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN event_id % 7 > 0 THEN value END AS price,
          CASE WHEN event_id % 5 > 0 THEN CAST(user_id AS DOUBLE) END AS size, 'h' || CAST(event_id AS VARCHAR) AS transaction_hash FROM events""",
    ),
    Query(
        "price_points_dedupe",
        points,
        f"""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS token_id, {E_HOUR} AS t, value / 500 AS p, event_id AS a, 0 AS b FROM events
          UNION ALL SELECT CAST(user_id AS VARCHAR), {E_HOUR} + 3600, value, event_id, 1 FROM events)
        SELECT token_id, t, p, strftime(TIMESTAMP '1970-01-01' + to_seconds(t), '%Y-%m-%d %H:%M:%S') AS time_utc FROM (
          SELECT *, row_number() OVER (PARTITION BY token_id, t ORDER BY a DESC, b DESC) AS rn FROM p) WHERE rn = 1""",
    ),
    Query(
        "candles_flat",
        flat_candles,
        f"""SELECT CAST(user_id AS VARCHAR) AS ticker, event_id AS row_pos, 'live' AS tier, {E_HOUR} AS end_period_ts, CAST(0.5 AS DOUBLE) AS trade_open,
          CASE WHEN event_id % 9 > 0 THEN value / 500 END AS trade_close, CAST(0.25 AS DOUBLE) AS bid_close, CAST(user_id AS DOUBLE) AS volume FROM events WHERE day(ts) <= 15 OR event_type = 'view'
        UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, 'archive', {E_HOUR}, NULL, CASE WHEN event_id % 9 > 0 THEN value / 500 END, NULL, value FROM events""",
    ),
    Query(
        "candles_last_wins",
        candles_last,
        f"""SELECT CAST(user_id AS VARCHAR) AS ticker, {E_HOUR} AS end_period_ts, max(event_id) AS row_pos,
          arg_max(CASE WHEN event_id % 9 > 0 THEN {{'v': value / 500}} ELSE {{'v': NULL}} END, event_id).v AS trade_close FROM events GROUP BY 1, 2""",
    ),
    Query(
        "candles_first_wins",
        candles_first,
        f"""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CASE WHEN event_id % 4 > 0 THEN {E_HOUR} END AS end_period_ts, event_id FROM events)
        SELECT ticker, end_period_ts, min(event_id) AS row_pos FROM c WHERE end_period_ts IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT * FROM c WHERE end_period_ts IS NULL""",
    ),
    Query("candle_tier_routing", routed, ROUTED.format(users="WHERE value > 100", thin="")),
    Query("candle_tier_routing_listed", routed_listed, ROUTED.format(users="", thin=f" WHERE t < {START + 3 * DAY}")),
    Query(
        "history_time_order",
        time_order,
        "SELECT CAST(user_id AS VARCHAR) AS ticker, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event, true AS in_order FROM events GROUP BY 1",
    ),
    Query(
        "trade_tiers",
        tiers,
        "WITH " + RANGES + """ SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'polymarket' ELSE 'kalshi' END AS platform,
          CASE WHEN o_orderkey % 3 > 0 AND s < (SELECT CAST(epoch(max(o_orderdate) - INTERVAL 700 DAYS) AS BIGINT) FROM orders WHERE o_orderkey % 3 > 0) THEN 'live+archive' ELSE 'live' END AS tiers FROM ranges""",
    ),
    Query(
        "holders_exploded",
        holder_rows,
        """SELECT CAST(l_partkey AS VARCHAR) AS token, CAST(l_suppkey AS VARCHAR) AS wallet, l_quantity AS amount, 0 AS outcome_index FROM lineitem WHERE l_linenumber <> 3
        UNION ALL SELECT CAST(l_partkey AS VARCHAR), CAST(l_orderkey AS VARCHAR), l_extendedprice, l_linenumber FROM lineitem WHERE l_linenumber <> 3""",
    ),
    Query(
        "market_details",
        details,
        """SELECT CAST(o_orderkey AS VARCHAR) AS ticker, CASE o_orderstatus WHEN 'O' THEN 'live ' || o_orderpriority WHEN 'F' THEN NULL ELSE 'old ' || o_orderpriority END AS details,
          CASE o_orderstatus WHEN 'O' THEN 'live' WHEN 'F' THEN NULL ELSE 'archive' END AS details_tier FROM orders""",
    ),
    Query(
        "time_windows",
        lambda spark, d: timewindows.time_windows(order_ranges(spark, d), 7 * DAY).select("o_orderkey", "window_index", "window_start", "window_end"),
        "WITH " + RANGES + """ SELECT o_orderkey, CAST(i AS INT) AS window_index, s + i * 604800 AS window_start, least(s + (i + 1) * 604800, e) AS window_end
          FROM ranges, LATERAL (SELECT unnest(range(0, (e - s + 604799) // 604800)) AS i)""",
    ),
    Query(
        "candle_windows",
        lambda spark, d: timewindows.candle_windows(order_ranges(spark, d), 60, bars_per_window=24, max_windows=10).select("o_orderkey", "window_index", "window_start", "window_end", "truncated"),
        "WITH " + RANGES + """ SELECT o_orderkey, CAST(i AS INT) AS window_index, s + i * 86400 AS window_start, least(s + (i + 1) * 86400 - 1, e) AS window_end, e - s + 1 > 864000 AS truncated
          FROM ranges, LATERAL (SELECT unnest(range(0, least((e - s) // 86400 + 1, 10))) AS i)""",
    ),
    Query(
        "candle_budget",
        budgets,
        "WITH " + RANGES + " SELECT o_orderkey, ((e - s) // 3600 + 2) * (o_orderkey % 100 + 1) AS candle_estimate, ((e - s) // 3600 + 2) * (o_orderkey % 100 + 1) <= 10000 AS fits FROM ranges",
    ),
    Query(
        "saturated_windows",
        saturated,
        f"""WITH RECURSIVE e AS (SELECT event_type, {E_SEC} AS sec FROM events WHERE {E_SEC} BETWEEN {START} AND {START + 40 * DAY}),
        w AS (SELECT event_type, CAST({START} AS BIGINT) AS lo, CAST({START + 40 * DAY} AS BIGINT) AS hi, count(*) AS n FROM e GROUP BY 1
          UNION ALL
          SELECT p.event_type, c.lo, c.hi, (SELECT count(*) FROM e WHERE e.event_type = p.event_type AND e.sec BETWEEN c.lo AND c.hi) AS n
          FROM w p, LATERAL (SELECT p.lo AS lo, (p.lo + p.hi) // 2 AS hi UNION ALL SELECT (p.lo + p.hi) // 2 + 1, p.hi) c WHERE p.n >= 80 AND p.lo < p.hi),
        q AS (SELECT *, CASE WHEN n >= 80 THEN 4 ELSE n // 20 + 1 END AS requests, sum(CASE WHEN n >= 80 THEN 4 ELSE n // 20 + 1 END) OVER (PARTITION BY event_type) AS total FROM w)
        SELECT event_type, lo AS window_start, hi AS window_end, n AS n_rows, requests, n >= 80 AS over_budget, total > 60 AS incomplete FROM q WHERE n < 80 OR lo = hi""",
    ),
]
