"""Venue payloads to one row per outcome, without guessing units or inventing prices.

Input is the candidate shape: raw market JSON, raw event JSON (or null), ``observed_at`` and
``row_pos``. Each payload is parsed once with an explicit schema; everything after that is a
projection, so a normalizer never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake import schemas
from oddslake.functions import (
    book_flags,
    casefold,
    cents,
    computed,
    fenced,
    first_present,
    json_list,
    midpoint,
    number,
    probability,
    sorted_set,
    truthy,
)
from oddslake.functions.scalar import exact, valid_probability
from oddslake.operators.topics import classify
from oddslake.sources.taxonomy import Taxonomy

# The fields that make up the classified text, headlines before details.
HEADLINE_FIELDS = [
    "question", "title", "subtitle", "sub_title", "yes_sub_title", "groupItemTitle",
    "series_title", "series_context", "country",
]
DETAIL_FIELDS = ["description", "rules_primary", "rules_secondary", "category"]
# A strict boolean in the payload and the flag it raises.
AVAILABILITY_FLAGS = [
    ("active", False, "market_inactive"),
    ("acceptingOrders", False, "not_accepting_orders"),
    ("enableOrderBook", False, "orderbook_disabled"),
    ("closed", True, "market_closed"),
    ("archived", True, "market_archived"),
]
SETTLED_STATUSES = ["determined", "finalized", "settled"]


def context_text(market: str, event: str) -> Column:
    """Text to classify: headline fields, then details, then tag labels, one per line."""
    parts = [
        truthy(F.col(f"{record}.{name}"))
        for names in (HEADLINE_FIELDS, DETAIL_FIELDS)
        for record in (market, event)
        for name in names
    ]
    tags = [F.transform(f"{record}.tags", lambda t: F.coalesce(t["label"], F.lit(""))) for record in (market, event)]
    return F.concat_ws("\n", *parts, *tags)


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _observed(run_time: Column | None) -> Column:
    moment = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if run_time is None else run_time
    return F.coalesce(truthy(F.col("observed_at")), moment)


def _labelled(rows: DataFrame, taxonomy: Taxonomy | None, labels: bool) -> DataFrame:
    """Rows with the labels of their ``__context``; without ``labels`` the label columns are null and cost nothing."""
    return (classify(rows, "__context", taxonomy) if labels else rows).drop("__context")


def normalize_polymarket(
    candidates: DataFrame, taxonomy: Taxonomy | None = None, run_time: Column | None = None, labels: bool = True
) -> DataFrame:
    """One row per outcome token. Displayed price first; the YES book midpoint only where no
    price is shown, the market is available and neither quote is a 0/1 placeholder."""
    with_market = computed(candidates, m=F.from_json("market", schemas.POLYMARKET_MARKET))
    first_event = F.get(F.filter("m.events", lambda e: e.startswith("{")), 0)
    parsed = computed(with_market, e=F.from_json(F.coalesce("event", first_event, F.lit("{}")), schemas.EVENT))
    m = lambda name: F.col(f"m.{name}")
    strings = lambda name: F.transform("m.tokens", lambda t: t[name])
    legacy = (F.size(json_list(m("outcomes"))) == 0) & (F.coalesce(F.size("m.tokens"), F.lit(0)) > 0)
    lists = computed(
        parsed,
        outcomes=F.when(legacy, strings("outcome")).otherwise(json_list(m("outcomes"))),
        prices=F.when(legacy, strings("price")).otherwise(json_list(m("outcomePrices"))),
        token_ids=F.when(legacy, strings("token_id")).otherwise(json_list(m("clobTokenIds"))),
    )
    flags = [F.when(m(f) == F.lit(v), F.lit(flag)) for f, v, flag in AVAILABILITY_FLAGS]
    closed = F.coalesce(
        m("closed"), ~F.coalesce(F.get_json_object("market", "$.closed"), F.lit("")).isin("", "0", "0.0", "[]", "{}")
    )
    market_id = first_present(m("id"), m("conditionId"), m("condition_id"))
    per_market = lists.select(
        "row_pos",
        context_text("m", "e").alias("__context"),
        F.lit("polymarket").alias("platform"),
        F.coalesce(
            truthy(first_present(m("question"), m("title"))), truthy(F.col("e.title")), F.lit("")
        ).alias("title"),
        _observed(run_time).alias("observed_at"),
        _text(market_id).alias("market_id"),
        first_present(m("conditionId"), m("condition_id")).alias("condition_id"),
        F.col("e.id").alias("event_id"),
        first_present(F.col("e.seriesSlug"), F.col("e.series_id")).alias("series_id"),
        number(first_present(m("volumeNum"), m("volume"))).alias("volume"),
        F.lit("USD_notional").alias("volume_unit"),
        number(m("volume24hr")).alias("volume_24h"),
        number(first_present(m("liquidityNum"), m("liquidity"))).alias("liquidity"),
        F.lit("USD").alias("liquidity_unit"),
        first_present(m("endDate"), m("end_date_iso")).alias("end_date"),
        _text(m("description")).alias("rules"),
        m("resolutionSource").alias("resolution_source"),
        F.when(closed, F.lit("closed")).when(m("active"), F.lit("active")).alias("status"),
        first_present(m("updatedAt"), m("updated_at")).alias("source_updated_at"),
        m("active").alias("active"),
        m("acceptingOrders").alias("accepting_orders"),
        F.array_compact(F.array(*flags)).alias("__unavailable"),
        F.size("outcomes").alias("__n_outcomes"),
        F.size("token_ids").alias("__n_tokens"),
        F.size("prices").alias("__n_prices"),
        (
            F.transform("outcomes", lambda o: F.lower(F.coalesce(o, F.lit("None"))))
            == F.array(F.lit("yes"), F.lit("no"))
        ).alias("__yes_first"),
        (
            (F.coalesce(F.size("m.tokens"), F.lit(0)) > 0)
            & F.coalesce(m("outcomes"), F.lit("")).isin("", "[]")
        ).alias("__token_shape"),
        probability(m("bestBid")).alias("__bid"),
        probability(m("bestAsk")).alias("__ask"),
        F.when(
            F.greatest(F.size("outcomes"), F.size("token_ids"), F.size("prices")) > 0,
            F.arrays_zip("outcomes", "prices", "token_ids"),
        )
        .otherwise(
            F.array(
                F.struct(
                    *[F.lit(None).cast("string").alias(c) for c in ("outcomes", "prices", "token_ids")]
                )
            )
        )
        .alias("__slots"),
    )
    # Labels depend on the market alone, so they are computed before outcomes are exploded.
    labelled = _labelled(per_market, taxonomy, labels)
    slots = labelled.select("*", F.posexplode("__slots").alias("outcome_pos", "slot")).drop("__slots")
    quoted = (F.col("outcome_pos") == 0) & F.col("__yes_first")
    priced = computed(
        slots,
        outcome=F.col("slot.outcomes"),
        token_id=F.col("slot.token_ids"),
        __raw=F.col("slot.prices"),
        __number=number(F.col("slot.prices")),
        bid=F.when(quoted, F.col("__bid")),
        ask=F.when(quoted, F.col("__ask")),
    )
    bid, ask, shown = F.col("bid"), F.col("ask"), valid_probability(F.col("__number"))
    spread, book_flag = book_flags(bid, ask)
    boundary = F.coalesce(bid == 0, F.lit(False)) | F.coalesce(ask == 1, F.lit(False))
    mid_allowed = spread.isNotNull() & (F.size("__unavailable") == 0) & ~boundary
    mismatch = (F.col("__n_outcomes") != F.col("__n_tokens")) | (
        (F.col("__n_prices") > 0) & (F.col("__n_prices") != F.col("__n_outcomes"))
    )
    row_flags = F.array_compact(
        F.array(
            F.when(mismatch, F.lit("outcome_array_length_mismatch")),
            F.when(F.col("__raw").isNotNull() & shown.isNull(), F.lit("invalid_outcome_price")),
            book_flag,
            F.when(boundary, F.lit("boundary_quotes_unverified")),
            F.when(F.col("outcome").isNull(), F.lit("missing_outcome_label")),
            F.when(F.col("token_id").isNull(), F.lit("missing_token_id")),
        )
    )
    shown_source = F.when(F.col("__token_shape"), F.lit("clob_token_price")).otherwise(F.lit("gamma_outcome_price"))
    rows = (
        priced.withColumn("spread", spread)
        .withColumn("probability", F.coalesce(shown, F.when(mid_allowed, midpoint(bid, ask))))
        .withColumn(
            "price_source",
            F.when(shown.isNotNull(), shown_source).when(mid_allowed, F.lit("gamma_yes_book_midpoint")),
        )
        .withColumn("quality_flags", F.array_sort(F.array_distinct(F.concat("__unavailable", row_flags))))
    )
    return _silver(rows)


def _silver(rows: DataFrame) -> DataFrame:
    """Bring a venue's rows to the common silver schema; fields a venue lacks are null."""
    present = set(rows.columns)
    empty = rows.sparkSession.createDataFrame([], schemas.OUTCOME_ROW).schema
    return rows.select(
        # The position keeps whatever orderable type the caller gave it.
        *[
            F.col("row_pos")
            if f.name == "row_pos"
            else (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in empty
        ]
    )


def has_key(name: str) -> Column:
    """Whether a parsed market has the key, even as null; ``__null_keys`` holds the keys where a null is possible."""
    return F.col(f"m.{name}").isNotNull() | F.coalesce(F.array_contains("__null_keys", name), F.lit(False))


def keyed_price(field: str) -> Column:
    """Dollar field if its key is present, even when null; else the legacy cent field."""
    dollars, legacy = F.col(f"__{field}_dollars"), cents(F.col(f"__{field}"))
    return F.when(F.col(f"__keyed_{field}"), valid_probability(dollars)).otherwise(valid_probability(legacy))


PRICE_FIELDS = ["yes_bid", "yes_ask", "no_bid", "last_price"]
SIZE_FIELDS = ["yes_bid_size", "yes_ask_size", "no_bid_size"]


def normalize_kalshi(
    candidates: DataFrame, taxonomy: Taxonomy | None = None, run_time: Column | None = None, labels: bool = True
) -> DataFrame:
    """One YES row per contract; settlement, then two-sided midpoint, then last trade."""
    # The keys matter only where a value is null, which takes the word in the payload.
    null_keys = F.when(F.contains("market", F.lit("null")), F.json_object_keys("market"))
    parsed = candidates.select(
        "*",
        F.from_json("market", schemas.KALSHI_MARKET).alias("m"),
        F.from_json(F.coalesce("event", F.lit("{}")), schemas.EVENT).alias("e"),
        null_keys.alias("__null_keys"),
    )
    m = lambda name: F.col(f"m.{name}")
    title = F.coalesce(truthy(m("title")), truthy(F.col("e.title")), truthy(m("ticker")), F.lit(""))
    subtitle = F.coalesce(truthy(m("yes_sub_title")), truthy(m("subtitle")), F.lit(""))
    # One projection reads all that the payload holds, with text made numbers, and no later one carries the payload;
    # the price rules below then only combine plain columns.
    settled = F.coalesce(m("result").isin("yes", "no") & m("status").isin(*SETTLED_STATUSES), F.lit(False))
    numbered = parsed.select(
        "row_pos",
        *[number(m(f"{field}{suffix}")).alias(f"__{field}{suffix}") for field in PRICE_FIELDS for suffix in ("_dollars", "")],
        *[has_key(f"{field}_dollars").alias(f"__keyed_{field}") for field in PRICE_FIELDS],
        *[number(first_present(m(f"{name}_fp"), m(name))).alias(f"__{name}") for name in SIZE_FIELDS],
        (has_key("yes_ask_dollars") | has_key("yes_ask")).alias("__own_ask"),
        (~F.coalesce(m("market_type"), F.lit("")).isin("", "binary")).alias("__nonbinary"),
        F.when(settled, m("result")).alias("__result"),
        title.alias("__title"),
        subtitle.alias("__subtitle"),
        *([context_text("m", "e").alias("__context")] if labels else []),
        _observed(run_time).alias("observed_at"),
        _text(m("ticker")).alias("market_id"),
        first_present(m("event_ticker"), F.col("e.event_ticker")).alias("event_id"),
        first_present(m("series_ticker"), F.col("e.series_ticker")).alias("series_id"),
        m("yes_sub_title").alias("outcome_label"),
        number(first_present(m("volume_fp"), m("volume"))).alias("volume"),
        number(first_present(m("volume_24h_fp"), m("volume_24h"))).alias("volume_24h"),
        number(first_present(m("open_interest_fp"), m("open_interest"))).alias("open_interest"),
        first_present(
            m("close_time"), m("expected_expiration_time"), m("expiration_time"), m("latest_expiration_time")
        ).alias("end_date"),
        F.concat_ws("\n\n", truthy(m("rules_primary")), truthy(m("rules_secondary"))).alias("rules"),
        m("status").alias("status"),
        F.when(has_key("market_type"), m("market_type")).otherwise(F.lit("binary")).alias("market_type"),
        m("updated_time").alias("source_updated_at"),
    )
    empty = lambda side: F.coalesce(F.col(f"__{side}_size") == 0, F.lit(False))
    complement = (F.lit(1).cast("decimal(28,18)") - exact(keyed_price("no_bid"))).cast("double")
    yes_ask = F.when(F.col("__own_ask"), F.when(~empty("yes_ask"), keyed_price("yes_ask"))).when(
        ~empty("no_bid") & ~empty("yes_ask"), complement
    )
    prices = {
        "bid": F.when(~empty("yes_bid"), keyed_price("yes_bid")), "ask": yes_ask, "__last": keyed_price("last_price"),
    }
    used = [c for c in numbered.columns if c != "__own_ask" and not c.startswith(tuple(f"__{x}" for x in (*PRICE_FIELDS, *SIZE_FIELDS, "keyed")))]
    quoted = fenced(numbered.select(*used, *[c.alias(name) for name, c in prices.items()]), "row_pos", "observed_at")
    bid, ask, last = F.col("bid"), F.col("ask"), F.col("__last")
    _, book_flag = book_flags(bid, ask)
    # Decimal forms serve the spread and the midpoint, which both take an uncrossed book.
    exact_bid, exact_ask = (F.when(bid <= ask, exact(side)) for side in (bid, ask))
    spread = (F.col("__exact_ask") - F.col("__exact_bid")).cast("double")
    middle = ((F.col("__exact_bid") + F.col("__exact_ask")) * F.lit("0.5").cast("decimal(2,1)")).cast("double")
    two_sided = F.col("spread").isNotNull()
    appended = (F.col("__subtitle") != "") & ~F.contains(casefold(F.col("__title")), casefold(F.col("__subtitle")))
    source = (
        F.when(F.col("__nonbinary"), F.lit(None).cast("string"))
        .when(F.col("__result").isNotNull(), F.lit("settlement_result"))
        .when(two_sided, F.lit("yes_book_midpoint"))
        .when(last.isNotNull(), F.lit("last_trade"))
    )
    rows = (
        quoted.withColumn("__exact_bid", exact_bid)
        .withColumn("__exact_ask", exact_ask)
        .withColumn("spread", spread)
        .withColumn("__book_flag", book_flag)
        .withColumn("price_source", source)
        .withColumn(
            "probability",
            F.when(F.col("price_source") == "settlement_result", (F.col("__result") == "yes").cast("double"))
            .when(F.col("price_source") == "yes_book_midpoint", middle)
            .when(F.col("price_source") == "last_trade", last),
        )
        .withColumn("title", F.when(appended, F.concat_ws(" — ", "__title", "__subtitle")).otherwise(F.col("__title")))
        .withColumns(
            {
                "outcome_pos": F.lit(0),
                "platform": F.lit("kalshi"),
                "outcome": F.lit("Yes"),
                "volume_unit": F.lit("contracts"),
                "quality_flags": sorted_set(
                    F.col("__book_flag"),
                    F.when(F.col("__nonbinary"), F.lit("nonbinary_contract_price_is_not_probability")),
                    F.when(F.col("price_source") == "last_trade", F.lit("last_trade_may_be_stale")),
                    F.lit("kalshi_liquidity_deprecated"),
                ),
            }
        )
    )
    return _silver(_labelled(rows, taxonomy, labels))


def normalize_candidates(
    candidates: DataFrame, taxonomy: Taxonomy | None = None, run_time: Column | None = None
) -> DataFrame:
    """Both venues in one table; each branch scans only its own ``platform`` partition."""
    return normalize_polymarket(
        candidates.filter(F.col("platform") == "polymarket"), taxonomy, run_time
    ).unionByName(normalize_kalshi(candidates.filter(F.col("platform") == "kalshi"), taxonomy, run_time))


__all__ = [
    "context_text",
    "keyed_price",
    "normalize_candidates",
    "normalize_kalshi",
    "normalize_polymarket",
]
