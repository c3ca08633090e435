"""Which landed response feeds which table: URL pattern, where its rows sit, their id."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Endpoint:
    """``rows`` is the key that holds the row list: "" for a list at the root, None where the
    whole object is one record. ``null_is_empty`` admits null for an empty list."""

    table: str
    path: str
    rows: str | None
    id_key: str | None = None
    null_is_empty: bool = False


def _gamma(table: str, path: str, rows: str | None, id_key: str | None = "id") -> Endpoint:
    return Endpoint(f"poly_{table}", rf"gamma-api\.[^/]+{path}$", rows, id_key)


def _clob(table: str, path: str, rows: str | None, id_key: str | None = None) -> Endpoint:
    return Endpoint(f"poly_{table}", rf"clob\.[^/]+{path}$", rows, id_key)


def _data(table: str, path: str, rows: str | None = "", id_key: str | None = None) -> Endpoint:
    return Endpoint(f"poly_{table}", rf"data-api\.[^/]+{path}$", rows, id_key)


def _kalshi(table: str, path: str, rows: str | None, id_key: str | None = None) -> Endpoint:
    return Endpoint(f"kalshi_{table}", rf"/trade-api/v2{path}$", rows, id_key, null_is_empty=True)


# The documented read routes of both venues, grouped by API.
ENDPOINTS = [
    _gamma("events", r"/events", ""),
    _gamma("events", r"/events/keyset", "events"),
    _gamma("markets", r"/markets", ""),
    _gamma("markets", r"/markets/keyset", "markets"),
    _gamma("market_detail", r"/markets/(?:slug/)?(?!keyset)[^/]+", None),
    _gamma("event_detail", r"/events/(?:slug/)?(?!keyset)[^/]+", None),
    _gamma("series", r"/series", ""),
    _gamma("series_detail", r"/series/[^/]+", None),
    _gamma("tags", r"/tags", ""),
    _gamma("tag_detail", r"/tags/(?:slug/)?[^/]+", None),
    _gamma("related_tags", r"/tags/(?:slug/)?[^/]+/related-tags(?:/tags)?", ""),
    _gamma("event_tags", r"/events/[^/]+/tags", ""),
    _gamma("market_tags", r"/markets/[^/]+/tags", ""),
    _gamma("comments", r"/comments(?:/user_address/[^/]+)?", ""),
    _gamma("profiles", r"/public-profile", None),
    _gamma("search_events", r"/public-search", "events"),
    _gamma("sports", r"/sports", "", None),
    _gamma("teams", r"/teams", ""),
    _clob("books", r"/book", None, "asset_id"),
    _clob("books", r"/books", "", "asset_id"),
    _clob("midpoints", r"/midpoints?", None),
    _clob("spreads", r"/spreads?", None),
    _clob("last_trade_prices", r"/last-trade-price", None),
    _clob("last_trade_prices", r"/last-trades-prices", ""),
    _clob("prices", r"/prices?", None),
    _clob("price_history", r"/prices-history", None),
    _clob("price_history_batch", r"/batch-prices-history", None),
    _clob("fee_rates", r"/fee-rate(?:/[^/]+)?", None),
    _clob("tick_sizes", r"/tick-size(?:/[^/]+)?", None),
    _clob("negative_risk", r"/neg-risk(?:/[^/]+)?", None),
    _clob("clob_markets", r"/(?:simplified-markets|sampling-markets|sampling-simplified-markets)", "data", "condition_id"),
    _clob("clob_market_detail", r"/(?:clob-markets|markets-by-token)/[^/]+", None, "condition_id"),
    _clob("live_activity", r"/markets/live-activity/[^/]+", None),
    _clob("live_activity", r"/markets/live-activity", ""),
    _clob("rewards", r"/rewards/markets/(?:current|multi|[^/]+)", "data", "condition_id"),
    _clob("builder_trades", r"/builder/trades", "data", "id"),
    _clob("account_trades", r"/data/trades", "data", "id"),
    _data("trades", r"/trades"),
    _data("activity", r"/activity"),
    _data("positions", r"/positions"),
    _data("closed_positions", r"/closed-positions"),
    _data("market_positions", r"/v1/market-positions"),
    _data("holders", r"/holders", "", "token"),
    _data("open_interest", r"/oi", "", "market"),
    _data("live_volume", r"/live-volume"),
    _data("value", r"/value"),
    _data("traded", r"/traded", None),
    _data("revisions", r"/revisions", None),
    _data("leaderboard", r"/v1/leaderboard"),
    _data("builder_leaderboard", r"/v1/builders/leaderboard"),
    _data("builder_volume", r"/v1/builders/volume"),
    _data("combo_positions", r"/v1/positions/combos", "combos"),
    _data("combo_activity", r"/v1/activity/combos", "activity"),
    Endpoint("poly_bridge_assets", r"bridge\.[^/]+/supported-assets$", "supportedAssets"),
    Endpoint("poly_bridge_status", r"bridge\.[^/]+/status/[^/]+$", "transactions"),
    Endpoint("poly_combo_markets", r"combos-rfq-api\.[^/]+/v1/rfq/combo-markets$", "markets"),
    Endpoint("poly_relayer", r"relayer-v2\.[^/]+/(?:transaction|transactions|nonce|relay-payload|deployed)$", None),
    # Perpetual-futures prices are context only; they are not probabilities.
    Endpoint("poly_perps", r"api\.perpetuals\.[^/]+/v1/info/[^/]+$", None),
    _kalshi("series", r"/series", "series", "ticker"),
    _kalshi("series_detail", r"/series/(?!fee_changes)[^/]+", "series", "ticker"),
    _kalshi("events", r"/events", "events", "event_ticker"),
    _kalshi("event_detail", r"/events/(?!fee_changes|multivariate)[^/]+", None, "event_ticker"),
    _kalshi("event_metadata", r"/events/[^/]+/metadata", None),
    _kalshi("markets", r"/markets", "markets", "ticker"),
    _kalshi("market_detail", r"/markets/(?!trades|orderbooks|candlesticks)[^/]+", None, "ticker"),
    _kalshi("books", r"/markets/[^/]+/orderbook", None),
    _kalshi("books_batch", r"/markets/orderbooks", "orderbooks", "ticker"),
    _kalshi("trades", r"/markets/trades", "trades", "trade_id"),
    _kalshi("candles", r"/series/[^/]+/(?:markets|events)/[^/]+/candlesticks", "candlesticks", "end_period_ts"),
    _kalshi("candles_batch", r"/markets/candlesticks", "markets", "market_ticker"),
    _kalshi("forecast_percentiles", r"/series/[^/]+/events/[^/]+/forecast_percentile_history", "forecast_history"),
    _kalshi("cutoff", r"/historical/cutoff", None),
    _kalshi("archived_markets", r"/historical/markets", "markets", "ticker"),
    _kalshi("archived_market_detail", r"/historical/markets/[^/]+", None, "ticker"),
    _kalshi("archived_trades", r"/historical/trades", "trades", "trade_id"),
    _kalshi("archived_candles", r"/historical/markets/[^/]+/candlesticks", "candlesticks", "end_period_ts"),
    _kalshi("tags", r"/search/tags_by_categories", None),
    _kalshi("status", r"/exchange/status", None),
    _kalshi("schedule", r"/exchange/schedule", None),
    _kalshi("fee_changes", r"/(?:series|events)/fee_changes", None),
    _kalshi("milestones", r"/milestones", "milestones", "id"),
    _kalshi("structured_targets", r"/structured_targets", "structured_targets", "id"),
    _kalshi("live_data", r"/live_data/.+", None),
    _kalshi("multivariate_events", r"/events/multivariate", "events", "event_ticker"),
    _kalshi("multivariate_collections", r"/multivariate_event_collections", "multivariate_contracts"),
    _kalshi("incentives", r"/incentive_programs", "incentive_programs", "id"),
    _kalshi("positions", r"/(?:portfolio|historical)/positions", "market_positions", "ticker"),
    _kalshi("fills", r"/(?:portfolio|historical)/fills", "fills", "fill_id"),
    _kalshi("orders", r"/(?:portfolio|historical)/orders", "orders", "order_id"),
    _kalshi("settlements", r"/portfolio/settlements", "settlements", "ticker"),
    _kalshi("balance", r"/portfolio/balance", None),
    _kalshi("account_limits", r"/account/(?:limits|endpoint_costs)", None),
]

BY_TABLE: dict[str, list[Endpoint]] = {}
for _endpoint in ENDPOINTS:
    BY_TABLE.setdefault(_endpoint.table, []).append(_endpoint)
