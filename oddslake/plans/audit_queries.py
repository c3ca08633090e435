"""Request-log audits, envelope routing, data checks and sinks over derived logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.operators import audit
from oddslake.plans.registry import Query, json_text, quoted, table, text
from oddslake.plans.snapshot_queries import ORDER
from oddslake.session import shared_dir
from oddslake.sources import catalog, envelopes, tables


GAMMA, KALSHI = "https://gamma-api.example.com", "https://api.example.com/trade-api/v2"


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per event: retries by status, and payloads of a right or wrong shape."""
    k = F.col("event_id") % 7
    url = (
        F.when(F.col("event_type") == "view", f"{GAMMA}/events").when(F.col("event_type") == "error", f"{GAMMA}/events/keyset?x=1").otherwise(f"{KALSHI}/markets/trades")
    )
    record = json_text(id=text("event_id"), trade_id=quoted(text("user_id")), props=F.col("props"))
    listed = F.concat(F.lit("["), record, F.lit(","), record, F.lit("]"))
    shape = F.col("user_id") % 5
    data = (
        F.when(F.col("event_type") == "view", F.when(shape == 0, record).when(shape == 1, F.lit("[1]")).otherwise(listed))
        .when(F.col("event_type") == "error", F.when(shape == 0, listed).otherwise(json_text(events=listed, next_cursor=F.lit('"x"'))))
        .otherwise(F.when(shape == 0, json_text(trades=F.lit("null"))).when(shape == 1, json_text(renamed=listed)).when(shape == 2, json_text(trades=record)).otherwise(json_text(trades=listed)))
    )
    failed = k == 6
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).cast("string").alias("run_id"),
        F.col("event_id").alias("row_pos"),
        F.lit("2026-01-01T00:00:00Z").alias("observed_at"),
        F.lit("GET").alias("method"),
        url.alias("url"),
        F.create_map(F.lit("user"), text("user_id")).alias("params"),
        F.lit(None).cast("string").alias("request_body"),
        F.when(~failed, F.element_at(F.array(*[F.lit(c) for c in (200, 200, 429, 200, 503, 404)]), (k + 1).cast("int"))).cast("int").alias("status_code"),
        (F.col("event_id") % 3 + 1).cast("int").alias("attempt"),
        F.when(~failed, data).alias("data"),
        F.when(failed, F.lit("ReadTimeout")).alias("error"),
        F.dayofmonth("ts").alias("day"),
    )


LOG = f"""
log AS (SELECT CAST(user_id % 50 AS VARCHAR) AS run_id, event_id, user_id, event_type, user_id % 5 AS shape,
  CASE event_type WHEN 'view' THEN '{GAMMA}/events' WHEN 'error' THEN '{GAMMA}/events/keyset?x=1' ELSE '{KALSHI}/markets/trades' END AS url,
  CASE WHEN event_id % 7 < 6 THEN [200, 200, 429, 200, 503, 404][event_id % 7 + 1] END AS status_code, event_id % 3 + 1 AS attempt, day(ts) AS day FROM events),
ok AS (SELECT * FROM log WHERE status_code = 200)"""
TABLES = ["poly_events", "kalshi_trades"]


def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.retry_audit(request_log(spark, sf_dir))
    return rows.select(
        "run_id", "url", F.regexp_extract("params", r'"value":"(\d+)"', 1).alias("user"), "attempts", "calls", "retryable_responses", "transport_failures", "last_status", "outcome"
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page walks per user and event type; cursors and pages repeat by arithmetic."""
    cursor = F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 13 == 0, "LTE=").otherwise((F.col("event_id") % 40).cast("string"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).cast("string").alias("run_id"),
        F.col("event_type").alias("endpoint"),
        text("user_id").alias("filters"),
        F.col("event_id").alias("row_pos"),
        F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 17).cast("string")).alias("cursor"),
        cursor.alias("next_cursor"),
        F.when(F.col("event_id") % 19 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"b":1,"id":'), (F.col("event_id") % 400).cast("string"), F.lit("}]"))).alias("rows_json"),
    )


def envelope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = envelopes.explode_tables(request_log(spark, sf_dir), TABLES)
    both = good["poly_events"].unionByName(good["kalshi_trades"])
    return both.select("table", "run_id", "row_pos", "item_pos", "id", F.get_json_object("payload", "$.props.k").alias("k"))


def bad_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = envelopes.explode_tables(request_log(spark, sf_dir), TABLES)
    return bad.select("table", "run_id", "row_pos", "reason")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.request_errors(request_log(spark, sf_dir)).groupBy("run_id", "operation", "error").agg(F.count(F.lit(1)).alias("times"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user and day: errors are its timeouts, warnings its distinct throttled URLs."""
    log = request_log(spark, sf_dir).withColumn("run_id", F.concat_ws("-", F.col("params")["user"], "day"))
    problems = envelopes.request_errors(log.filter(F.col("error").isNotNull()))
    notices = log.filter(F.col("status_code") == 429).select("run_id", F.col("url").alias("warning"))
    user, day = F.col("user_id"), F.dayofmonth("ts")
    runs = table(spark, sf_dir, "events").select(
        F.concat_ws("-", text("user_id"), day).alias("run_id"), (day < 28).alias("finished"), (user % 10 == 1).alias("fatal")
    ).distinct()
    return audit.run_status(log, problems, notices, runs)


def rules() -> dict[str, Column]:
    return {
        "price_in_range": F.col("l_discount").between(0, 0.08),
        "known_status": F.col("l_linestatus").isin("O", "F"),
        "positive_size": F.col("l_quantity") > 1,
    }


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OpenAPI document per supplier; some have no paths."""
    op = lambda name: json_text(summary=quoted(F.col("s_name")), operationId=quoted(F.concat(F.lit(name), text("s_suppkey"))), parameters=F.lit('[{"name":"limit"}]'))
    get_ = F.when(F.col("s_nationkey") % 2 == 0, op("get")).otherwise(json_text(security=F.lit("[]"), deprecated=F.lit("true")))
    item = json_text(parameters=F.lit('[{"name":"id"}]'), get=get_, POST=op("post"), trace=op("trace"))
    doc = json_text(
        info=json_text(version=quoted(text("s_nationkey"))), security=F.lit('[{"key":[]}]'),
        paths=F.when(F.col("s_suppkey") % 9 == 0, F.lit("null")).otherwise(json_text(**{"/a": item, "/b/{id}": json_text(delete=op("del"))})),
    )
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("api"), F.concat(F.lit("u"), text("s_suppkey")).alias("url"), doc.alias("content"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.api_operations(documents(spark, sf_dir))["operations"]
    return rows.select("api", "method", "path", "summary", "operation_id", "security", F.size("parameters").alias("parameters"), "deprecated", "research_use")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalog.api_operations(documents(spark, sf_dir))
    good = out["sources"].select("api", "url", "version", (F.length("sha256") == 64).alias("hashed"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(out["errors"].select("api", "url", F.lit(None).cast("string").alias("version"), F.lit(False).alias("hashed"), "error"))


def safe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*[F.lit(c) for c in ("=", "+", "-", "@", "", "\t", "\r")]), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, "text").alias("body"), F.array("lang", "source").alias("labels"), (-F.col("n_chars")).alias("delta"))
    return tables.csv_safe(rows).select("doc_id", F.sha2("body", 256).alias("body_hash"), "labels", "delta")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") > 3, F.col("c_name")).alias("name"), F.array("c_mktsegment").alias("tags"))
    return tables.json_document(rows)


def previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT, z STRING").alias("props"))
    return tables.preview(rows, ["event_id", "props.k", "props.missing", "absent"])


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions given by a parallel sort, reduced to the neighbour each row precedes."""
    rows = tables.with_row_pos(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey")
    ends = rows.agg(F.min_by("o_orderkey", "row_pos").alias("first_order"), F.max_by("o_orderkey", "row_pos").alias("last_order"), F.countDistinct("row_pos").alias("positions"))
    return ends


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["orders", "lineitem", "events", "documents"]
    return audit.dataset_counts({n: table(spark, sf_dir, n) for n in names})


# One response for each contract: route, table, where its rows sit ("." a list at the root, "-" the whole object), key
# of their id ("-" none). Written out here apart from the contracts, so that the SQL does not depend on them.
SAMPLES = [
    line.split(" ")
    for line in """
gamma-api.example.com/events poly_events . id
gamma-api.example.com/events/keyset poly_events events id
gamma-api.example.com/markets poly_markets . id
gamma-api.example.com/markets/keyset poly_markets markets id
gamma-api.example.com/markets/x1 poly_market_detail - id
gamma-api.example.com/events/x1 poly_event_detail - id
gamma-api.example.com/series poly_series . id
gamma-api.example.com/series/x1 poly_series_detail - id
gamma-api.example.com/tags poly_tags . id
gamma-api.example.com/tags/x1 poly_tag_detail - id
gamma-api.example.com/tags/x1/related-tags poly_related_tags . id
gamma-api.example.com/events/x1/tags poly_event_tags . id
gamma-api.example.com/markets/x1/tags poly_market_tags . id
gamma-api.example.com/comments poly_comments . id
gamma-api.example.com/public-profile poly_profiles - id
gamma-api.example.com/public-search poly_search_events events id
gamma-api.example.com/sports poly_sports . -
gamma-api.example.com/teams poly_teams . id
clob.example.com/book poly_books - asset_id
clob.example.com/books poly_books . asset_id
clob.example.com/midpoints poly_midpoints - -
clob.example.com/spreads poly_spreads - -
clob.example.com/last-trade-price poly_last_trade_prices - -
clob.example.com/last-trades-prices poly_last_trade_prices . -
clob.example.com/prices poly_prices - -
clob.example.com/prices-history poly_price_history - -
clob.example.com/batch-prices-history poly_price_history_batch - -
clob.example.com/fee-rate poly_fee_rates - -
clob.example.com/tick-size poly_tick_sizes - -
clob.example.com/neg-risk poly_negative_risk - -
clob.example.com/simplified-markets poly_clob_markets data condition_id
clob.example.com/clob-markets/x1 poly_clob_market_detail - condition_id
clob.example.com/markets/live-activity/x1 poly_live_activity - -
clob.example.com/markets/live-activity poly_live_activity . -
clob.example.com/rewards/markets/current poly_rewards data condition_id
clob.example.com/builder/trades poly_builder_trades data id
clob.example.com/data/trades poly_account_trades data id
data-api.example.com/trades poly_trades . -
data-api.example.com/activity poly_activity . -
data-api.example.com/positions poly_positions . -
data-api.example.com/closed-positions poly_closed_positions . -
data-api.example.com/v1/market-positions poly_market_positions . -
data-api.example.com/holders poly_holders . token
data-api.example.com/oi poly_open_interest . market
data-api.example.com/live-volume poly_live_volume . -
data-api.example.com/value poly_value . -
data-api.example.com/traded poly_traded - -
data-api.example.com/revisions poly_revisions - -
data-api.example.com/v1/leaderboard poly_leaderboard . -
data-api.example.com/v1/builders/leaderboard poly_builder_leaderboard . -
data-api.example.com/v1/builders/volume poly_builder_volume . -
data-api.example.com/v1/positions/combos poly_combo_positions combos -
data-api.example.com/v1/activity/combos poly_combo_activity activity -
bridge.example.com/supported-assets poly_bridge_assets supportedAssets -
bridge.example.com/status/x1 poly_bridge_status transactions -
combos-rfq-api.example.com/v1/rfq/combo-markets poly_combo_markets markets -
relayer-v2.example.com/transaction poly_relayer - -
api.perpetuals.example.com/v1/info/x1 poly_perps - -
api.example.com/trade-api/v2/series kalshi_series series ticker
api.example.com/trade-api/v2/series/x1 kalshi_series_detail series ticker
api.example.com/trade-api/v2/events kalshi_events events event_ticker
api.example.com/trade-api/v2/events/x1 kalshi_event_detail - event_ticker
api.example.com/trade-api/v2/events/x1/metadata kalshi_event_metadata - -
api.example.com/trade-api/v2/markets kalshi_markets markets ticker
api.example.com/trade-api/v2/markets/x1 kalshi_market_detail - ticker
api.example.com/trade-api/v2/markets/x1/orderbook kalshi_books - -
api.example.com/trade-api/v2/markets/orderbooks kalshi_books_batch orderbooks ticker
api.example.com/trade-api/v2/markets/trades kalshi_trades trades trade_id
api.example.com/trade-api/v2/series/x1/markets/x1/candlesticks kalshi_candles candlesticks end_period_ts
api.example.com/trade-api/v2/markets/candlesticks kalshi_candles_batch markets market_ticker
api.example.com/trade-api/v2/series/x1/events/x1/forecast_percentile_history kalshi_forecast_percentiles forecast_history -
api.example.com/trade-api/v2/historical/cutoff kalshi_cutoff - -
api.example.com/trade-api/v2/historical/markets kalshi_archived_markets markets ticker
api.example.com/trade-api/v2/historical/markets/x1 kalshi_archived_market_detail - ticker
api.example.com/trade-api/v2/historical/trades kalshi_archived_trades trades trade_id
api.example.com/trade-api/v2/historical/markets/x1/candlesticks kalshi_archived_candles candlesticks end_period_ts
api.example.com/trade-api/v2/search/tags_by_categories kalshi_tags - -
api.example.com/trade-api/v2/exchange/status kalshi_status - -
api.example.com/trade-api/v2/exchange/schedule kalshi_schedule - -
api.example.com/trade-api/v2/series/fee_changes kalshi_fee_changes - -
api.example.com/trade-api/v2/milestones kalshi_milestones milestones id
api.example.com/trade-api/v2/structured_targets kalshi_structured_targets structured_targets id
api.example.com/trade-api/v2/live_data/a/b kalshi_live_data - -
api.example.com/trade-api/v2/events/multivariate kalshi_multivariate_events events event_ticker
api.example.com/trade-api/v2/multivariate_event_collections kalshi_multivariate_collections multivariate_contracts -
api.example.com/trade-api/v2/incentive_programs kalshi_incentives incentive_programs id
api.example.com/trade-api/v2/portfolio/positions kalshi_positions market_positions ticker
api.example.com/trade-api/v2/portfolio/fills kalshi_fills fills fill_id
api.example.com/trade-api/v2/portfolio/orders kalshi_orders orders order_id
api.example.com/trade-api/v2/portfolio/settlements kalshi_settlements settlements ticker
api.example.com/trade-api/v2/portfolio/balance kalshi_balance - -
api.example.com/trade-api/v2/account/limits kalshi_account_limits - -
""".strip().splitlines()
]


def every_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response per event, to each of the contracts' routes in turn, some with a query string."""
    n, e = len(SAMPLES), F.col("event_id")
    pick = lambda i: F.element_at(F.array(*[F.lit(sample[i]) for sample in SAMPLES]), (e % n + 1).cast("int"))
    key, id_key = pick(2), pick(3)
    record = lambda place: F.concat(
        F.lit('{"'), F.when(id_key == "-", "nothing").otherwise(id_key), F.lit('":"'), text("event_id"), F.lit(f'-{place}","amount":'), text("user_id"), F.lit("}")
    )
    pair = F.concat(F.lit("["), record(0), F.lit(","), record(1), F.lit("]"))
    data = F.when(key == "-", record(0)).when(key == ".", pair).otherwise(F.concat(F.lit('{"cursor":"","'), key, F.lit('":'), pair, F.lit("}")))
    return table(spark, sf_dir, "events").select(
        F.lit("r").alias("run_id"), e.alias("row_pos"), F.lit("2026-01-01T00:00:00Z").alias("observed_at"),
        F.concat(F.lit("https://"), pick(0), F.when(e % 3 == 0, "?limit=9").otherwise("")).alias("url"),
        F.create_map(F.lit("limit"), F.lit("9")).alias("params"), F.when(e % 10 == 9, 500).otherwise(200).alias("status_code"), data.alias("data"),
    )


def endpoint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = envelopes.explode_envelopes(every_route(spark, sf_dir))
    return rows.select("table", "row_pos", "item_pos", "id", F.get_json_object("payload", "$.amount").cast("bigint").alias("amount"))


def landed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table as landed in one partitioned write, counted by folder."""
    landed = envelopes.land_tables(every_route(spark, sf_dir), f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    return landed.groupBy("table").agg(F.count(F.lit(1)).alias("rows"), F.count("id").alias("ids"), F.sum(F.get_json_object("payload", "$.amount").cast("bigint")).alias("amount"))


_SAMPLE_ROWS = ", ".join(f"({i}, '{table_name}', '{key}', '{id_key}')" for i, (_, table_name, key, id_key) in enumerate(SAMPLES))
ENDPOINT_ROWS = f"""
claims AS (SELECT tab, event_id, i, CASE WHEN id_key <> '-' THEN CAST(event_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) END AS id, user_id AS amount
  FROM events JOIN (VALUES {_SAMPLE_ROWS}) v(n, tab, key, id_key) ON event_id % {len(SAMPLES)} = n CROSS JOIN (SELECT unnest([0, 1]) AS i)
  WHERE event_id % 10 <> 9 AND (i = 0 OR key <> '-'))"""


def endpoint_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many logged responses each endpoint contract claims, over the whole log."""
    return envelopes.claimed(request_log(spark, sf_dir)).groupBy(F.col("__rule.table").alias("table")).agg(F.count(F.lit(1)).alias("responses"))


QUERIES = [
    Query(
        "retry_audit",
        retries,
        "WITH" + LOG + """, g AS (SELECT run_id, url, CAST(user_id AS VARCHAR) AS user, count(*) AS attempts, count(*) FILTER (attempt = 1) AS calls, count(*) FILTER (status_code IN (408, 429, 500, 502, 503, 504)) AS retryable_responses,
          count(*) FILTER (status_code IS NULL) AS transport_failures, arg_max({'v': status_code}, event_id).v AS last_status FROM log GROUP BY ALL)
        SELECT *, CASE WHEN last_status IS NULL THEN 'transport_failure' WHEN last_status = 200 THEN 'success' WHEN last_status IN (429, 503) THEN 'retries_exhausted' ELSE 'terminal_error' END AS outcome FROM g""",
    ),
    Query(
        "pagination_audit",
        lambda spark, d: audit.pagination_audit(pages(spark, d)),
        """WITH p AS (SELECT CAST(user_id % 50 AS VARCHAR) AS run_id, event_type AS endpoint, CAST(user_id AS VARCHAR) AS filters, event_id,
            CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 17 AS VARCHAR) ELSE '' END AS cursor, CASE WHEN event_id % 11 > 0 AND event_id % 13 > 0 THEN CAST(event_id % 40 AS VARCHAR) END AS nxt,
            CASE WHEN event_id % 19 > 0 THEN event_id % 400 END AS page FROM events),
        walks AS (SELECT run_id, endpoint, filters, count(*) AS pages, count(*) FILTER (page IS NULL) AS empty_pages, count(page) AS filled, count(DISTINCT page) AS dp,
            arg_max(coalesce(nxt, ''), event_id) AS last_cursor, arg_min(cursor, event_id) AS first_cursor FROM p GROUP BY ALL),
        offered AS (SELECT run_id, endpoint, filters, nxt FROM p WHERE nxt IS NOT NULL UNION ALL SELECT run_id, endpoint, filters, first_cursor FROM walks WHERE first_cursor <> ''),
        rc AS (SELECT run_id, endpoint, filters, count(*) AS n FROM (SELECT *, count(*) AS c FROM offered GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
        rp AS (SELECT run_id, endpoint, filters, count(*) AS n FROM (SELECT run_id, endpoint, filters, page, count(*) AS c FROM p WHERE page IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)
        SELECT run_id, endpoint, filters, pages, empty_pages, coalesce(rp.n, 0) AS repeated_pages, coalesce(rc.n, 0) AS repeated_cursors,
          CASE WHEN rp.n > 0 THEN 'repeated_page' WHEN rc.n > 0 THEN 'repeated_cursor' WHEN last_cursor <> '' THEN 'incomplete_cursor_remains' ELSE 'complete' END AS status
        FROM walks LEFT JOIN rc USING (run_id, endpoint, filters) LEFT JOIN rp USING (run_id, endpoint, filters)""",
    ),
    Query(
        "envelope_rows",
        envelope_rows,
        "WITH" + LOG + """ SELECT CASE WHEN event_type IN ('view', 'error') THEN 'poly_events' ELSE 'kalshi_trades' END AS "table", run_id, event_id AS row_pos, CAST(i AS INT) AS item_pos,
          CAST(CASE WHEN event_type IN ('view', 'error') THEN event_id ELSE user_id END AS VARCHAR) AS id, regexp_extract(props, '(\\d+)', 1) AS k
        FROM ok JOIN (SELECT event_id, props FROM events) USING (event_id), (SELECT unnest([0, 1]) AS i)
        WHERE (event_type = 'view' AND shape > 1) OR (event_type = 'error' AND shape > 0) OR (event_type NOT IN ('view', 'error') AND shape > 2)""",
    ),
    Query(
        "bad_envelopes",
        bad_envelopes,
        "WITH" + LOG + """, b AS (SELECT *, CASE WHEN event_type = 'view' THEN CASE shape WHEN 0 THEN 'expected a list at the root' WHEN 1 THEN 'a row is not an object' END
          WHEN event_type = 'error' THEN CASE WHEN shape = 0 THEN 'expected an object containing events' END
          ELSE CASE shape WHEN 1 THEN 'missing expected field trades' WHEN 2 THEN 'field trades is not a list' END END AS reason FROM ok)
        SELECT CASE WHEN event_type IN ('view', 'error') THEN 'poly_events' ELSE 'kalshi_trades' END AS "table", run_id, event_id AS row_pos, reason FROM b WHERE reason IS NOT NULL""",
    ),
    Query(
        "endpoint_claims",
        endpoint_tables,
        "WITH" + LOG + """ SELECT CASE WHEN event_type IN ('view', 'error') THEN 'poly_events' ELSE 'kalshi_trades' END AS "table", count(*) AS responses FROM ok GROUP BY 1""",
    ),
    Query(
        "endpoint_rows",
        endpoint_rows,
        f'WITH {ENDPOINT_ROWS} SELECT tab AS "table", event_id AS row_pos, CAST(i AS INT) AS item_pos, id, CAST(amount AS BIGINT) AS amount FROM claims',
    ),
    Query(
        "endpoint_tables_landed",
        landed_tables,
        f'WITH {ENDPOINT_ROWS} SELECT tab AS "table", count(*) AS rows, count(id) AS ids, CAST(sum(amount) AS BIGINT) AS amount FROM claims GROUP BY 1',
    ),
    Query(
        "request_errors",
        errors,
        "WITH" + LOG + " SELECT run_id, 'GET ' || url AS operation, coalesce('HTTP ' || CAST(status_code AS VARCHAR), 'ReadTimeout') AS error, count(*) AS times FROM log WHERE status_code IS DISTINCT FROM 200 GROUP BY ALL",
    ),
    Query(
        "run_status",
        statuses,
        "WITH" + LOG + """, u AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(day AS VARCHAR) AS run_id, user_id, day, count(*) AS request_count, count(*) FILTER (status_code IS NULL) AS error_count,
          count(DISTINCT CASE WHEN status_code = 429 THEN url END) AS warning_count FROM log GROUP BY ALL)
        SELECT run_id, day < 28 AS finished, user_id % 10 = 1 AS fatal, request_count, error_count, warning_count,
          CASE WHEN day >= 28 THEN 'running' WHEN user_id % 10 = 1 THEN 'failed' WHEN error_count > 0 OR warning_count > 0 THEN 'partial' ELSE 'complete_within_requested_scope' END AS status,
          CASE WHEN user_id % 10 = 1 OR error_count > 0 THEN 2 ELSE 0 END AS exit_code FROM u""",
    ),
    Query(
        "range_violations",
        lambda spark, d: audit.check_ranges(table(spark, d, "lineitem"), rules()),
        """SELECT 'price_in_range' AS rule, count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.08) AS violations FROM lineitem UNION ALL SELECT 'known_status', count(*) FILTER (l_linestatus NOT IN ('O', 'F')) FROM lineitem
        UNION ALL SELECT 'positive_size', count(*) FILTER (NOT l_quantity > 1) FROM lineitem""",
    ),
    Query(
        "violating_rows",
        lambda spark, d: audit.violations(table(spark, d, "lineitem"), rules()).select("rule", *ORDER[1:4], "l_orderkey", "l_linenumber"),
        """SELECT 'price_in_range' AS rule, l_partkey, l_suppkey, l_quantity, l_orderkey, l_linenumber FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.08
        UNION ALL SELECT 'positive_size', l_partkey, l_suppkey, l_quantity, l_orderkey, l_linenumber FROM lineitem WHERE NOT l_quantity > 1""",
    ),
    Query(
        "dataset_row_counts",
        counts,
        "SELECT 'orders' AS dataset, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents",
    ),
    Query(
        "api_operations",
        operations,
        """WITH d AS (SELECT *, CAST(s_suppkey AS VARCHAR) AS k, s_nationkey % 2 = 0 AS full_get FROM supplier WHERE s_suppkey % 9 > 0)
        SELECT s_name AS api, 'GET' AS method, '/a' AS path, CASE WHEN full_get THEN s_name END AS summary, CASE WHEN full_get THEN 'get' || k END AS operation_id,
          CASE WHEN full_get THEN '[{"key":[]}]' ELSE '[]' END AS security, CASE WHEN full_get THEN 2 ELSE 1 END AS parameters, NOT full_get AS deprecated, 'GET extraction candidate' AS research_use FROM d
        UNION ALL SELECT s_name, 'POST', '/a', s_name, 'post' || k, '[{"key":[]}]', 2, false, 'review; most are state-changing' FROM d
        UNION ALL SELECT s_name, 'DELETE', '/b/{id}', s_name, 'del' || k, '[{"key":[]}]', 1, false, 'review; most are state-changing' FROM d""",
    ),
    Query(
        "api_sources",
        sources,
        """SELECT s_name AS api, 'u' || CAST(s_suppkey AS VARCHAR) AS url, CASE WHEN s_suppkey % 9 > 0 THEN CAST(s_nationkey AS VARCHAR) END AS version, s_suppkey % 9 > 0 AS hashed,
          CASE WHEN s_suppkey % 9 = 0 THEN 'No OpenAPI paths in response' END AS error FROM supplier""",
    ),
    Query(
        "csv_safe_text",
        safe_text,
        """SELECT doc_id, sha256(CASE WHEN regexp_matches(body, '^[=+\\-@\\t\\r]') THEN '''' || body ELSE body END) AS body_hash, '["' || lang || '","' || source || '"]' AS labels, -n_chars AS delta
        FROM (SELECT *, ['=', '+', '-', '@', '', chr(9), chr(13)][doc_id % 7 + 1] || text AS body FROM documents)""",
    ),
    Query(
        "json_documents",
        json_rows,
        """SELECT '{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"name":' || CASE WHEN c_nationkey > 3 THEN '"' || c_name || '"' ELSE 'null' END || ',"tags":["' || c_mktsegment || '"]}' AS document FROM customer""",
    ),
    Query(
        "flat_preview",
        previewed,
        "SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS props_k, NULL AS props_missing, NULL AS absent FROM events",
    ),
    Query(
        "row_positions",
        numbered,
        "SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS first_order, (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey DESC LIMIT 1) AS last_order, (SELECT count(*) FROM orders) AS positions",
    ),
]
