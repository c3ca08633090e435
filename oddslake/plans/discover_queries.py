"""Discovery and collection over series from ``part``, events from ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.operators import collect, discover
from oddslake.plans.normalize_queries import TAXONOMY, kalshi_candidates
from oddslake.plans.registry import Query, epoch, json_text, quoted, table, text
from oddslake.sources.taxonomy import Taxonomy

SERIES_TAXONOMY = Taxonomy(
    {
        "us_context_terms": ["hot", "large", "US"],
        "foreign_context_terms": ["Canada"],
        "topics": {
            "rings": {"terms": ["ring"], "sectors": ["metal"]},
            "bolts": {"terms": ["bolt", "hot bolt"], "sectors": ["metal"]},
            "midterms_2026": {"terms": ["senate winner"], "sectors": []},
        },
    }
)
TITLES = ["House winner", "US Senate Control?", "House Race Winner", "Senate primary", "Governor of Canada", "Senate combo"]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per part: every seventh is an election family, the others keep the part name."""
    n = len(TITLES)
    family = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("p_size") % n + 1).cast("int"))
    election = F.col("p_partkey") % 7 == 0
    source = F.struct(
        F.concat(F.lit("Office "), text("p_size")).alias("name"),
        F.concat(F.lit("https://www."), F.element_at(F.array(*[F.lit(h) for h in ("BLS.gov", "notbls.gov", "clerk.house.gov", "example.com")]), (F.col("p_size") % 4 + 1).cast("int")), F.lit("/x")).alias("url"),
    )
    return table(spark, sf_dir, "part").select(
        text("p_partkey").alias("ticker"),
        F.when(election, family).otherwise(F.col("p_name")).alias("title"),
        F.when(election & (F.col("p_size") % 5 > 0), "Elections").otherwise(F.col("p_type")).alias("category"),
        F.when(F.col("p_size") % 11 == 0, F.array(F.lit("International"))).when(F.col("p_size") % 3 == 0, F.array(F.lit("US Elections"), F.lit("x"))).alias("tags"),
        F.when(F.col("p_size") % 10 == 0, "0.00").otherwise(text("p_retailprice")).alias("volume_fp"),
        F.lit(None).cast("string").alias("volume"),
        F.array(F.struct(F.lit("first").alias("name"), F.lit("not a url").alias("url")), source).alias("settlement_sources"),
    )


SERIES_SQL = """
s AS (SELECT CAST(p_partkey AS VARCHAR) AS ticker, p_size, p_partkey % 7 = 0 AS el,
  CASE WHEN p_partkey % 7 = 0 THEN ['House winner','US Senate Control?','House Race Winner','Senate primary','Governor of Canada','Senate combo'][p_size % 6 + 1] ELSE p_name END AS title,
  CASE WHEN p_partkey % 7 = 0 AND p_size % 5 > 0 THEN 'Elections' ELSE p_type END AS category,
  CASE WHEN p_size % 11 = 0 THEN '[''International'']' WHEN p_size % 3 = 0 THEN '[''US Elections'', ''x'']' ELSE '' END AS tags,
  CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_retailprice END AS volume,
  CASE p_size % 4 WHEN 0 THEN ' United States official settlement source Office ' || CAST(p_size AS VARCHAR)
    WHEN 2 THEN ' United States official settlement source Office ' || CAST(p_size AS VARCHAR) ELSE '' END AS note FROM part),
c AS (SELECT *, title || ' ' || ticker || ' ' || category || ' ' || tags || note AS context FROM s),
f AS (SELECT *, regexp_matches(context, '(?i)\\b(hot|large|us)\\b') AS us, regexp_matches(context, '(?i)\\bcanada\\b') AS foreign_,
  regexp_matches(context, '(?i)\\b(senate|congress)\\b') AS chamber,
  regexp_matches(context, '(?i)\\bring\\b') AS ring, regexp_matches(context, '(?i)\\bbolt\\b') AS bolt, regexp_matches(context, '(?i)\\bsenate[ _-]+winner\\b') AS sw FROM c),
r AS (SELECT *, CASE WHEN us THEN NULL WHEN foreign_ THEN 'foreign_context_without_explicit_us_link' WHEN NOT chamber THEN 'missing_us_context' END AS reason FROM f),
l AS (SELECT *, reason IS NULL AND ring AS t_ring, reason IS NULL AND bolt AS t_bolt, reason IS NULL AND sw AS t_sw FROM r),
m AS (SELECT *, CAST(t_ring AS INT) + CAST(t_bolt AS INT) + CAST(t_sw AS INT) * 6 AS relevance,
  tags NOT LIKE '%International%' AND coalesce(reason, '') <> 'foreign_context_without_explicit_us_link' AND el AND regexp_matches(title, '(?i)\\b(house|senate|governor)\\b')
    AND (category = 'Elections' OR regexp_matches(context, '(?i)US Elections|\\b(house|senate)\\b.*\\b(control|winner|election|race)\\b')) AS cand FROM l),
p AS (SELECT *, CASE WHEN NOT cand THEN 0 WHEN volume = 0 THEN 1 WHEN title IN ('House winner', 'US Senate Control?') THEN 6 WHEN title = 'House Race Winner' THEN 5
  WHEN title IN ('Senate primary', 'Senate combo') THEN 2 ELSE 4 END AS priority FROM m WHERE t_ring OR t_bolt OR t_sw OR cand)"""


def matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = discover.matching_series(series(spark, sf_dir), SERIES_TAXONOMY)
    return rows.select("ticker", "title", "context", "midterm_candidate", "priority", "relevance_score", "exclude_reason")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighty leading series with their place; the limit is the report."""
    top = discover.rank_series(discover.matching_series(series(spark, sf_dir), SERIES_TAXONOMY), 80)
    return top.withColumn("place", F.monotonically_increasing_id() + 1).select("place", "ticker", "priority", "relevance_score")


def absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.absent_series(series(spark, sf_dir), ["1", "2", "none", "999999999", "none"])


def explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = discover.matching_series(series(spark, sf_dir), SERIES_TAXONOMY, series_tickers=["7", "14", "15"], topics=["midterms_2026"])
    return rows.select("ticker", "priority")


def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest well-quoted market per order, from the raw market JSON of its lines."""
    markets = kalshi_candidates(spark, sf_dir).withColumn("event_ticker", F.get_json_object("event", "$.event_ticker"))
    quotes = discover.with_quotes(markets.select("event_ticker", "market"), more=["open_interest"])
    quotes = quotes.withColumn("volume_24h", F.col("open_interest").cast("double"))
    rows = discover.event_closeness(quotes)
    return rows.select("event_ticker", F.round("distance", 6).alias("distance"), "volume_24h", "unquoted")


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per order with up to three nested markets, some of them closed or without id."""
    rule = F.when(F.col("o_custkey") % 2 == 0, "If the House member sworn in for the term beginning in 2027 wins").otherwise("Some rule about Congress")
    child = lambda i: json_text(
        ticker=F.when(F.col("o_custkey") % 13 == i, F.lit("null")).otherwise(quoted(F.concat(F.lit(f"M{i}-"), (F.col("o_orderkey") % 5000).cast("string")))),
        status=quoted(F.when(F.col("o_custkey") % (i + 2) == 0, "active").otherwise("closed")), rules_primary=quoted(rule), title=quoted(F.col("o_orderpriority")),
    )
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("-26", "-2026", "-28", "")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    children = F.concat(F.lit("["), child(0), F.lit(","), child(1), F.lit(","), child(2), F.lit("]"))
    event = json_text(
        event_ticker=quoted(F.concat(text("o_orderkey"), suffix)), title=quoted(F.lit("Event")), markets=F.when(F.col("o_orderkey") % 9 == 0, F.lit("null")).otherwise(children), extra=F.lit('{"b":[1,null]}')
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", event.alias("event"), F.lit("2026-01-01T00:00:00Z").alias("observed_at"), F.col("o_orderkey").alias("row_pos"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    markets = F.from_json("event", "markets ARRAY<STRING>")["markets"]
    found = discover.cycle_evidence(F.get_json_object("event", "$.event_ticker"), F.coalesce(markets, F.array().cast("array<string>")))
    rows = nested_events(spark, sf_dir).withColumn("c", found).filter(F.col("c").isNotNull())
    return rows.select("o_orderkey", F.col("c.year").alias("year"), F.col("c.rule").alias("rule"), F.col("c.basis").alias("basis"))


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = discover.explode_markets(nested_events(spark, sf_dir))
    return rows.withColumn("platform", F.lit("kalshi")).withColumn("row_pos", F.struct("row_pos", "market_pos"))


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _children(spark, sf_dir)
    return rows.select("o_orderkey", "market_pos", F.get_json_object("market", "$.ticker").alias("ticker"), F.get_json_object("event", "$.title").alias("event_title"), F.get_json_object("event", "$.markets").isNull().alias("siblings_dropped"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = discover.unique_candidates(discover.open_markets(_children(spark, sf_dir)))
    return unique.select("platform", "candidate_id", "o_orderkey", "market_pos")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oddslake.operators.normalize import normalize_candidates

    raw = kalshi_candidates(spark, sf_dir).withColumn("platform", F.lit("kalshi"))
    unique = discover.unique_candidates(discover.open_markets(raw))
    labelled = normalize_candidates(unique, TAXONOMY)
    return discover.coverage_counts(unique, labelled, ["jobs"])


def selectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    market = json_text(
        acceptingOrders=flag(F.col("o_orderstatus") != "F"), enableOrderBook=flag(F.col("o_custkey") % 3 > 0), conditionId=quoted(F.when(F.col("o_custkey") % 5 == 0, "").otherwise("0x1")),
        clobTokenIds=F.when(F.col("o_custkey") % 7 == 0, F.lit('"[]"')).otherwise(F.lit('["1"]')), volume24hr=quoted(F.col("o_totalprice")),
        outcomePrices=F.when(F.col("o_custkey") % 4 == 0, F.lit('["0.4","0.6"]')).otherwise(F.lit('["0.05","0.95"]')),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", market.alias("market"))
    return discover.selectable_markets(rows)


def chosen_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.sample_market(selectable(spark, sf_dir), F.col("o_orderkey")).select("o_orderkey")


def largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.largest_volume(table(spark, sf_dir, "orders"), F.col("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome rows from ``lineitem``: two venues, ids missing in a regular pattern."""
    kalshi = F.col("l_orderkey") % 3 == 0
    return table(spark, sf_dir, "lineitem").select(
        F.when(kalshi, "kalshi").otherwise("polymarket").alias("platform"),
        F.when(~kalshi & (F.col("l_orderkey") % 5 == 0), F.concat(F.lit("0x"), text("l_orderkey"))).otherwise(text("l_orderkey")).alias("market_id"),
        text("l_linenumber").alias("outcome"),
        F.when(~kalshi & (F.col("l_suppkey") % 10 > 0), text("l_suppkey")).alias("token_id"),
        F.when(~kalshi & (F.col("l_orderkey") % 2 == 0), F.concat(F.lit("0xc"), text("l_orderkey"))).alias("condition_id"),
        F.when(F.col("l_orderkey") % 4 > 0, (F.col("l_orderkey") % 100).cast("string")).alias("event_id"),
        F.when(kalshi & (F.col("l_orderkey") % 6 == 0), F.lit("S")).alias("series_id"),
        F.col("l_orderkey").alias("row_pos"),
    )


def contract_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.contracts(outcome_rows(spark, sf_dir)).select("platform", "market_id", "condition_id", "event_id", "series_id", "outcomes", "first_pos")


def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, _ = collect.select_contracts(outcome_rows(spark, sf_dir), 25)
    return chosen.withColumn("place", F.monotonically_increasing_id() + 1).select("place", "platform", "market_id", F.col("turn").cast("bigint").alias("turn"))


def interleaved_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long choice over positions that are structs."""
    rows = outcome_rows(spark, sf_dir)
    chosen, _ = collect.select_contracts(rows.withColumn("row_pos", F.struct(F.col("row_pos").alias("a"), F.lit(0).alias("b"))), 150)
    return chosen.withColumn("place", F.monotonically_increasing_id() + 1).select("place", "platform", "market_id", F.col("turn").cast("bigint").alias("turn"))


def _routes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return collect.dataset_routes(outcome_rows(spark, sf_dir), collect.DATASETS)


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir)["routes"].groupBy("platform", "dataset", "id_kind").agg(F.count(F.lit(1)).alias("lookups"), F.countDistinct("id").alias("ids"))


def route_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir)["errors"].groupBy("operation", "error").agg(F.count(F.lit(1)).alias("times"))


def route_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir)["warnings"].groupBy("platform", "warning").agg(F.count(F.lit(1)).alias("contracts"))


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of the forty chosen contracts, joined on the id each venue uses."""
    item = table(spark, sf_dir, "lineitem")
    prints = lambda prefix: item.select(F.concat(F.lit(prefix), text("l_orderkey")).alias("id"), "l_extendedprice")
    out = collect.collect_datasets(outcome_rows(spark, sf_dir), {"polymarket": {"trades": prints("0xc")}, "kalshi": {"trades": prints("")}}, max_markets=40)
    return _per_contract(out["polymarket_trades"].unionByName(out["kalshi_trades"]))


def _per_contract(trades: DataFrame) -> DataFrame:
    return trades.groupBy("platform", "market_id").agg(F.count(F.lit(1)).alias("trades"), F.max("l_extendedprice").alias("largest"))


RANGE = (820_454_400, 852_076_800)  # the year 1996


def collected_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of one year of all contracts; Kalshi's archive holds a share of them once more."""
    item = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", *[text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")])
    prints = lambda prefix: item.select(
        F.concat(F.lit(prefix), text("l_orderkey")).alias("id"), epoch("l_shipdate").alias("ts"), key.alias("trade_key"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_pos"), "l_extendedprice", "l_suppkey",
    )
    live, archive = prints("").filter("l_suppkey % 4 > 0"), prints("").filter("l_suppkey % 4 < 2").withColumn("l_extendedprice", F.col("l_extendedprice") + 1)
    cutoffs = spark.createDataFrame([("kalshi", "1996-06-01T00:00:00Z")], "platform STRING, trades_created_ts STRING")
    out = collect.collect_datasets(
        outcome_rows(spark, sf_dir), {"polymarket": {"trades": prints("0xc")}, "kalshi": {"trades": live}},
        archives={"kalshi": {"trades": archive}}, cutoffs=cutoffs, start=RANGE[0], end=RANGE[1],
    )
    columns = ["platform", "market_id", "l_extendedprice"]
    return _per_contract(out["polymarket_trades"].select(*columns).unionByName(out["kalshi_trades"].select(*columns)))


ROWS = """
o AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'kalshi' ELSE 'polymarket' END AS platform, l_orderkey AS pos,
  CASE WHEN l_orderkey % 3 > 0 AND l_orderkey % 5 = 0 THEN '0x' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS market_id,
  CASE WHEN l_orderkey % 3 > 0 AND l_suppkey % 10 > 0 THEN CAST(l_suppkey AS VARCHAR) END AS token_id,
  CASE WHEN l_orderkey % 3 > 0 AND l_orderkey % 2 = 0 THEN '0xc' || CAST(l_orderkey AS VARCHAR) END AS condition_id,
  CASE WHEN l_orderkey % 4 > 0 THEN CAST(l_orderkey % 100 AS VARCHAR) END AS event_id,
  CASE WHEN l_orderkey % 6 = 0 THEN 'S' END AS series_id FROM lineitem),
k AS (SELECT platform, market_id, any_value(condition_id) AS condition_id, any_value(event_id) AS event_id, any_value(series_id) AS series_id, count(*) AS outcomes, min(pos) AS first_pos FROM o GROUP BY 1, 2),
kc AS (SELECT *, coalesce(condition_id, CASE WHEN market_id LIKE '0x%' THEN market_id END) AS cond FROM k),
turns AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY first_pos) AS turn, min(first_pos) OVER (PARTITION BY platform) AS venue_first FROM k)"""
EVENTS = """
e AS (SELECT o_orderkey, o_custkey, o_orderkey % 9 > 0 AS has, ['-26','-2026','-28',''][o_orderkey % 4 + 1] AS suffix FROM orders),
ch AS (SELECT o_orderkey, i AS market_pos, CASE WHEN o_custkey % 13 <> i THEN 'M' || CAST(i AS VARCHAR) || '-' || CAST(o_orderkey % 5000 AS VARCHAR) END AS ticker, o_custkey % (i + 2) = 0 AS active
  FROM e, (SELECT unnest([0, 1, 2]) AS i) WHERE has)"""

QUERIES = [
    Query("series_matching", matching, "WITH" + SERIES_SQL + " SELECT ticker, title, context, cand AS midterm_candidate, priority, relevance AS relevance_score, coalesce(reason, CASE WHEN NOT (t_ring OR t_bolt OR t_sw) THEN 'no_target_topic' END) AS exclude_reason FROM p"),
    Query(
        "series_rank_topk",
        ranked,
        "WITH" + SERIES_SQL + " SELECT place, ticker, priority, relevance AS relevance_score FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, relevance DESC, volume DESC, ticker) AS place FROM p) WHERE place <= 80",
    ),
    Query("series_absent", absent, "SELECT ticker FROM (VALUES ('1'), ('2'), ('none'), ('999999999')) v(ticker) WHERE ticker NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)"),
    Query("series_explicit", explicit, "WITH" + SERIES_SQL.replace(" WHERE t_ring OR t_bolt OR t_sw OR cand", "") + " SELECT ticker, priority FROM p WHERE ticker IN ('7', '14', '15')"),
    Query(
        "event_closeness",
        closeness,
        """WITH q AS (SELECT l_orderkey, l_quantity, l_suppkey % 6 AS shape, round(l_tax * 10, 1) AS b, round(l_discount * 10, 1) AS a FROM lineitem),
        g AS (SELECT l_orderkey, l_quantity, a, b, shape IN (0, 1, 4) AND b <= a AND a - b <= 0.15 AND NOT (shape = 4 AND l_quantity < 10) AS quoted FROM q)
        SELECT CAST(l_orderkey AS VARCHAR) AS event_ticker, round(min(CASE WHEN quoted THEN abs((b + a) / 2 - 0.5) END), 6) AS distance, sum(l_quantity) AS volume_24h,
          CASE WHEN bool_or(quoted) THEN 0 ELSE 1 END AS unquoted FROM g GROUP BY l_orderkey""",
    ),
    Query(
        "cycle_evidence",
        evidence,
        "WITH" + EVENTS + """ SELECT o_orderkey, 2026 AS year, 'If the House member sworn in for the term beginning in 2027 wins' AS rule, 'Election ticker suffix and congressional term beginning in 2027' AS basis
          FROM e WHERE has AND suffix IN ('-26', '-2026') AND o_custkey % 2 = 0""",
    ),
    Query("nested_markets", exploded, "WITH" + EVENTS + " SELECT o_orderkey, market_pos, ticker, 'Event' AS event_title, true AS siblings_dropped FROM ch"),
    Query(
        "candidates_first_wins",
        candidates,
        "WITH" + EVENTS + " SELECT 'kalshi' AS platform, ticker AS candidate_id, o_orderkey, market_pos FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY o_orderkey, market_pos) AS rn FROM ch WHERE active AND ticker IS NOT NULL) WHERE rn = 1",
    ),
    Query(
        "coverage_counts",
        coverage,
        """WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'R')
        SELECT 'kalshi' AS platform, count(*) AS candidate_markets, count(*) FILTER (l_partkey % 6 = 2) AS selected_outcome_rows, count(*) FILTER (l_partkey % 6 <> 2) AS unclassified_markets FROM u""",
    ),
    Query(
        "selectable_markets",
        lambda spark, d: selectable(spark, d).select("o_orderkey"),
        "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 3 > 0 AND o_custkey % 5 > 0 AND o_custkey % 7 > 0",
    ),
    Query(
        "sample_market",
        chosen_sample,
        "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 3 > 0 AND o_custkey % 5 > 0 AND o_custkey % 7 > 0 ORDER BY o_custkey % 4 = 0 DESC, o_totalprice DESC, o_orderkey LIMIT 1",
    ),
    Query("largest_volume_market", largest, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1"),
    Query(
        "ordered_unique_values",
        lambda spark, d: discover.ordered_unique(table(spark, d, "orders"), "o_custkey", F.col("o_orderkey")),
        "SELECT o_custkey, min(o_orderkey) AS first_pos FROM orders GROUP BY 1",
    ),
    Query("contract_groups", contract_groups, "WITH" + ROWS + " SELECT platform, market_id, condition_id, event_id, series_id, outcomes, first_pos FROM k"),
    Query(
        "venue_interleave",
        interleaved,
        "WITH" + ROWS + " SELECT place, platform, market_id, turn FROM (SELECT *, row_number() OVER (ORDER BY turn, venue_first) AS place FROM turns) WHERE place <= 25",
    ),
    Query(
        "venue_interleave_many",
        interleaved_many,
        "WITH" + ROWS + " SELECT place, platform, market_id, turn FROM (SELECT *, row_number() OVER (ORDER BY turn, venue_first) AS place FROM turns) WHERE place <= 150",
    ),
    Query(
        "dataset_routes",
        routes,
        "WITH" + ROWS + """, x AS (
          SELECT platform, unnest(['books', 'history']) AS dataset, 'token_id' AS id_kind, token_id AS id FROM o WHERE platform = 'polymarket' AND token_id IS NOT NULL
          UNION ALL SELECT platform, unnest(['trades', 'holders', 'open_interest']), 'condition_id', cond FROM kc WHERE platform = 'polymarket' AND cond IS NOT NULL
          UNION ALL SELECT platform, 'comments', 'event_id', event_id FROM kc WHERE platform = 'polymarket' AND event_id IS NOT NULL
          UNION ALL SELECT platform, unnest(['books', 'trades', 'open_interest']), 'ticker', market_id FROM kc WHERE platform = 'kalshi'
          UNION ALL SELECT platform, 'history', 'ticker', market_id FROM kc WHERE platform = 'kalshi' AND series_id IS NOT NULL)
        SELECT platform, dataset, id_kind, count(*) AS lookups, count(DISTINCT id) AS ids FROM x GROUP BY ALL""",
    ),
    Query(
        "dataset_route_errors",
        route_errors,
        "WITH" + ROWS + """ SELECT operation, error, count(*) AS times FROM (
          SELECT 'polymarket:' || market_id AS operation, 'Missing outcome token ID' AS error FROM o WHERE platform = 'polymarket' AND token_id IS NULL
          UNION ALL SELECT 'polymarket:' || market_id, 'Missing condition_id for Data API; rediscover with current normalizer' FROM kc WHERE platform = 'polymarket' AND cond IS NULL
          UNION ALL SELECT 'kalshi:' || market_id || ':candles', 'Missing series_id; preserve discovery event metadata' FROM kc WHERE platform = 'kalshi' AND series_id IS NULL) GROUP BY ALL""",
    ),
    Query(
        "dataset_route_warnings",
        route_warnings,
        "WITH" + ROWS + " SELECT platform, 'Kalshi public API does not expose comments, holders; those datasets were skipped for Kalshi contracts' AS warning, count(*) AS contracts FROM k WHERE platform = 'kalshi' GROUP BY ALL",
    ),
    Query(
        "collected_range",
        collected_range,
        "WITH" + ROWS + """, ids AS (SELECT platform, market_id, CASE WHEN platform = 'kalshi' THEN market_id ELSE coalesce(condition_id, CASE WHEN market_id LIKE '0x%' THEN market_id END) END AS id FROM turns),
        prints AS (SELECT *, CAST(epoch(CAST(l_shipdate AS TIMESTAMP)) AS BIGINT) AS ts FROM lineitem),
        kalshi AS (SELECT '' || CAST(l_orderkey AS VARCHAR) AS id, l_extendedprice + CASE WHEN l_suppkey % 4 < 2 THEN 1 ELSE 0 END AS price FROM prints WHERE ts >= 820454400 AND ts < 852076800),
        poly AS (SELECT '0xc' || CAST(l_orderkey AS VARCHAR) AS id, l_extendedprice AS price FROM prints WHERE ts >= 820454400 AND ts < 852076800)
        SELECT platform, market_id, count(*) AS trades, max(price) AS largest FROM (
          SELECT platform, market_id, price FROM ids JOIN kalshi USING (id) WHERE platform = 'kalshi'
          UNION ALL SELECT platform, market_id, price FROM ids JOIN poly USING (id) WHERE platform = 'polymarket') GROUP BY 1, 2""",
    ),
    Query(
        "collected_trades",
        collected,
        "WITH" + ROWS + """, pick AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY turn, venue_first) AS place FROM turns) WHERE place <= 40),
        ids AS (SELECT platform, market_id, CASE WHEN platform = 'kalshi' THEN market_id ELSE coalesce(condition_id, CASE WHEN market_id LIKE '0x%' THEN market_id END) END AS id FROM pick)
        SELECT ids.platform, ids.market_id, count(*) AS trades, max(l_extendedprice) AS largest FROM ids JOIN lineitem ON ids.id = CASE WHEN ids.platform = 'kalshi' THEN '' ELSE '0xc' END || CAST(l_orderkey AS VARCHAR) GROUP BY 1, 2""",
    ),
]
