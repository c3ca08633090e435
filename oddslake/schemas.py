"""Explicit schemas of landed payloads and silver tables; nothing is inferred in a job."""

from __future__ import annotations

TAG = "STRUCT<label:STRING>"

# Landed payloads. Fields are text because venues mix JSON numbers and decimal strings; typed
# columns are derived afterwards and the raw JSON stays beside them.
POLYMARKET_MARKET = f"""
id STRING, question STRING, title STRING, subtitle STRING, sub_title STRING, yes_sub_title STRING,
groupItemTitle STRING, series_title STRING, series_context STRING, country STRING, description STRING,
rules_primary STRING, rules_secondary STRING, category STRING, tags ARRAY<{TAG}>,
conditionId STRING, condition_id STRING, outcomes STRING, outcomePrices STRING, clobTokenIds STRING,
tokens ARRAY<STRUCT<outcome:STRING,price:STRING,token_id:STRING>>, bestBid STRING, bestAsk STRING,
active BOOLEAN, acceptingOrders BOOLEAN, enableOrderBook BOOLEAN, closed BOOLEAN, archived BOOLEAN,
volumeNum STRING, volume STRING, volume24hr STRING, liquidityNum STRING, liquidity STRING,
endDate STRING, end_date_iso STRING, resolutionSource STRING, updatedAt STRING, updated_at STRING,
events ARRAY<STRING>"""

EVENT = f"""
id STRING, question STRING, title STRING, subtitle STRING, sub_title STRING, yes_sub_title STRING,
groupItemTitle STRING, series_title STRING, series_context STRING, country STRING, description STRING,
rules_primary STRING, rules_secondary STRING, category STRING, tags ARRAY<{TAG}>,
seriesSlug STRING, series_id STRING, event_ticker STRING, series_ticker STRING"""

KALSHI_MARKET = f"""
ticker STRING, event_ticker STRING, series_ticker STRING, question STRING, title STRING, subtitle STRING,
sub_title STRING, yes_sub_title STRING, groupItemTitle STRING, series_title STRING, series_context STRING,
country STRING, description STRING, rules_primary STRING, rules_secondary STRING, category STRING,
tags ARRAY<{TAG}>, market_type STRING, status STRING, result STRING,
yes_bid_dollars STRING, yes_bid STRING, yes_ask_dollars STRING, yes_ask STRING,
no_bid_dollars STRING, no_bid STRING, last_price_dollars STRING, last_price STRING,
yes_bid_size_fp STRING, yes_bid_size STRING, yes_ask_size_fp STRING, yes_ask_size STRING,
no_bid_size_fp STRING, no_bid_size STRING, volume_fp STRING, volume STRING, volume_24h_fp STRING,
volume_24h STRING, open_interest_fp STRING, open_interest STRING, close_time STRING,
expected_expiration_time STRING, expiration_time STRING, latest_expiration_time STRING, updated_time STRING"""

KALSHI_SERIES = """
ticker STRING, title STRING, category STRING, tags ARRAY<STRING>, volume_fp STRING, volume STRING,
settlement_sources ARRAY<STRUCT<name:STRING,url:STRING>>"""

CANDLE_SIDE = "STRUCT<open_dollars:STRING,high_dollars:STRING,low_dollars:STRING,close_dollars:STRING,open:STRING,high:STRING,low:STRING,close:STRING>"
CANDLE = f"""
end_period_ts BIGINT, price {CANDLE_SIDE}, yes_bid {CANDLE_SIDE}, yes_ask {CANDLE_SIDE},
volume_fp STRING, volume STRING, open_interest_fp STRING, open_interest STRING"""

KALSHI_TRADE = """
trade_id STRING, ticker STRING, created_time STRING, yes_price_dollars STRING, no_price_dollars STRING,
count_fp STRING, taker_outcome_side STRING, taker_book_side STRING"""

POLYMARKET_TRADE = """
conditionId STRING, asset STRING, timestamp BIGINT, outcome STRING, side STRING, price STRING, size STRING,
transactionHash STRING, proxyWallet STRING"""

HOLDER_GROUP = "token STRING, holders ARRAY<STRUCT<proxyWallet:STRING,amount:STRING,outcomeIndex:INT>>"

# Bronze tables.
ENVELOPE = """
run_id STRING, row_pos BIGINT, observed_at STRING, method STRING, url STRING, params MAP<STRING,STRING>,
request_body STRING, status_code INT, attempt INT, data STRING, error STRING"""

FRAME = """
run_id STRING, row_pos BIGINT, observed_at STRING, kind STRING, connection_id INT, url STRING,
subscription STRING, data STRING, error STRING, detail STRING"""

MANIFEST = """
run_id STRING, schema_version INT, command STRING, started_at STRING, finished_at STRING, status STRING,
settings MAP<STRING,STRING>, request_count BIGINT,
errors ARRAY<STRUCT<operation:STRING,error:STRING,observed_at:STRING>>, warnings ARRAY<STRING>"""

API_DOCUMENT = "api STRING, url STRING, content STRING"

# A market as handed to the normalizers: raw JSON of the market and of its event.
CANDIDATE = "platform STRING, market STRING, event STRING, observed_at STRING, row_pos BIGINT"

# Silver: one row per outcome.
OUTCOME_ROW = """
platform STRING, title STRING, observed_at STRING, topics ARRAY<STRING>,
matched_terms MAP<STRING,ARRAY<STRING>>, sectors ARRAY<STRING>, relevance_score INT, exclude_reason STRING,
market_id STRING, condition_id STRING, event_id STRING, series_id STRING, outcome STRING,
outcome_label STRING, token_id STRING, probability DOUBLE, price_source STRING, bid DOUBLE, ask DOUBLE,
spread DOUBLE, volume DOUBLE, volume_unit STRING, volume_24h DOUBLE, open_interest DOUBLE, liquidity DOUBLE,
liquidity_unit STRING, end_date STRING, rules STRING, resolution_source STRING, status STRING,
market_type STRING, source_updated_at STRING, active BOOLEAN, accepting_orders BOOLEAN,
quality_flags ARRAY<STRING>, row_pos BIGINT, outcome_pos INT"""


def columns(ddl: str) -> list[str]:
    """Top-level column names of a DDL string."""
    depth, names, part = 0, [], ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            names.append(part.split()[0])
            part = ""
        else:
            part += ch
    return names
