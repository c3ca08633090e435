"""Selected contracts joined to landed datasets, each on the identifier that dataset uses.

Each dataset stays its own table keyed by contract instead of being nested under it, so a
contract with a billion trades is many rows, not one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.functions import latest_by, salted_join, truthy
from oddslake.operators.discover import interleave
from oddslake.operators.history import in_time_order, merge_latest, route_candles, trade_tiers
from oddslake.operators.timewindows import CANDLES_PER_REQUEST, default_range
from oddslake.session import stored

# The messages of collection, in the order in which they are used below.
LIMITED = "Collection limited to %d of %d contracts"
NO_TOKEN = "Missing outcome token ID"
NO_CONDITION = "Missing condition_id for Data API; rediscover with current normalizer"
NO_SERIES = "Missing series_id; preserve discovery event metadata"
NOT_OFFERED = "Kalshi public API does not expose {}; those datasets were skipped for Kalshi contracts"
# Identifier per (venue, dataset), and the datasets a venue does not offer.
DATASET_KEYS = [
    ("polymarket", "books", "token_id"),
    ("polymarket", "history", "token_id"),
    ("polymarket", "trades", "condition_id"),
    ("polymarket", "holders", "condition_id"),
    ("polymarket", "open_interest", "condition_id"),
    ("polymarket", "comments", "event_id"),
    ("kalshi", "books", "ticker"),
    ("kalshi", "history", "ticker"),
    ("kalshi", "trades", "ticker"),
    ("kalshi", "open_interest", "ticker"),
]
UNSUPPORTED = {"kalshi": ["comments", "holders"]}
DATASETS = ["books", "history", "trades", "holders", "open_interest", "comments"]


def contracts(rows: DataFrame, pos: str = "row_pos") -> DataFrame:
    """One row per (platform, market_id): the identifiers of its first outcome row, the number
    of outcomes and the first position."""
    wanted = ["condition_id", "event_id", "series_id", "series_ticker"]
    filled = rows.withColumns({c: F.lit(None).cast("string") for c in wanted if c not in rows.columns})
    slim = filled.select("platform", "market_id", *wanted, F.col(pos).alias("__pos"))
    return latest_by(slim, ["platform", "market_id"], F.col("__pos"), "first", "outcomes", "first_pos", drop=["__pos"])


def select_contracts(rows: DataFrame, max_markets: int | None = None, pos: str = "row_pos") -> tuple[DataFrame, DataFrame]:
    """(chosen contracts, one-row notice with the total); venues take turns under a limit, else all are chosen."""
    all_contracts = contracts(rows, pos)
    notice = all_contracts.agg(F.count(F.lit(1)).alias("contracts")).select(
        "contracts",
        F.lit(max_markets).cast("int").alias("max_markets"),
        F.when(
            F.col("contracts") > F.lit(max_markets).cast("int"),
            F.format_string(LIMITED, F.lit(max_markets).cast("int"), F.col("contracts")),
        ).alias("warning"),
    )
    return (all_contracts if max_markets is None else interleave(all_contracts, max_markets)), notice


def condition_id() -> Column:
    """Data key of a Polymarket contract: the condition id, or a market id that already is one."""
    return F.coalesce(truthy(F.col("condition_id")), F.when(F.col("market_id").startswith("0x"), F.col("market_id")))


def dataset_routes(
    rows: DataFrame, datasets: Sequence[str] = ("books", "history", "trades"), pos: str = "row_pos"
) -> dict[str, DataFrame]:
    """What to look up for each contract: ``routes`` (one id per contract or token and
    dataset), ``errors`` (a required id is missing) and ``warnings`` (not offered)."""
    unknown = sorted(set(datasets) - set(DATASETS))
    if unknown:
        raise ValueError("Unknown datasets: " + ", ".join(unknown))
    spark = rows.sparkSession
    per_contract = contracts(rows, pos).withColumn("condition", condition_id())
    kinds = [(v, d, k) for v, d, k in DATASET_KEYS if d in datasets]
    # A fixed table of at most ten rows.
    plan = F.broadcast(spark.createDataFrame(kinds or [("", "", "")], "platform STRING, dataset STRING, id_kind STRING"))
    base = ["platform", "market_id", "dataset", "id_kind"]

    by_contract = per_contract.join(plan.filter(F.col("id_kind") != "token_id"), "platform").withColumn(
        "id",
        F.when(F.col("id_kind") == "condition_id", F.col("condition"))
        .when(F.col("id_kind") == "event_id", truthy(F.col("event_id")))
        .otherwise(F.col("market_id")),
    )
    no_series = (F.col("platform") == "kalshi") & (F.col("dataset") == "history") & F.coalesce(truthy(F.col("series_id")), truthy(F.col("series_ticker"))).isNull()
    tokens = rows.withColumns({c: F.lit(None).cast("string") for c in ("token_id", "outcome") if c not in rows.columns})
    by_token = (
        tokens.filter(F.col("platform") == "polymarket")
        .select("platform", "market_id", "outcome", truthy(F.col("token_id")).alias("id"))
        .join(plan.filter(F.col("id_kind") == "token_id"), "platform")
    )
    blank = F.lit(None).cast("string")
    routes = (
        by_contract.filter(F.col("id").isNotNull() & ~no_series)
        .select(*base, "id", blank.alias("outcome"))
        .unionByName(by_token.filter(F.col("id").isNotNull()).select(*base, "id", "outcome"))
    )
    label = F.concat_ws(":", "platform", "market_id")
    missing_token = (
        tokens.filter((F.col("platform") == "polymarket") & truthy(F.col("token_id")).isNull())
        .select(label.alias("operation"), F.lit(NO_TOKEN).alias("error"))
    )
    missing_condition = (
        by_contract.filter((F.col("id_kind") == "condition_id") & F.col("id").isNull())
        .select(label.alias("operation"), F.lit(NO_CONDITION).alias("error"))
        .distinct()
    )
    missing_series = by_contract.filter(no_series).select(
        F.concat(label, F.lit(":candles")).alias("operation"),
        F.lit(NO_SERIES).alias("error"),
    )
    unsupported = sorted(set(datasets) & set(UNSUPPORTED["kalshi"]))
    warnings = per_contract.filter((F.col("platform") == "kalshi") & F.lit(bool(unsupported))).select(
        "platform",
        "market_id",
        F.lit(NOT_OFFERED.format(", ".join(unsupported))).alias("warning"),
    )
    return {
        "routes": routes,
        "errors": missing_token.unionByName(missing_condition).unionByName(missing_series),
        "warnings": warnings,
    }


def collect_datasets(
    rows: DataFrame,
    tables: Mapping[str, Mapping[str, DataFrame]],
    *,
    archives: Mapping[str, Mapping[str, DataFrame]] | None = None,
    archived_markets: Mapping[str, DataFrame] | None = None,
    cutoffs: DataFrame | None = None,
    start: int | None = None,
    end: int | None = None,
    run_epoch: int | None = None,
    period_minutes: int = 60,
    max_markets: int | None = None,
    pos: str = "row_pos",
) -> dict[str, DataFrame]:
    """Landed dataset rows of the selected contracts, trades and history of a time range.

    ``tables[platform][dataset]`` is a table with an ``id`` column of the kind :data:`DATASET_KEYS`
    names; trades and history also have ``ts``, epoch seconds. ``end`` defaults to ``run_epoch`` and
    ``start`` to a week before it; without either nothing is cut. The range reaches the scan:
    trades and points of [start, end), candles of [start, end] whose window needs them. ``archives``
    holds the archived tier: trades join in if the range starts before the venue's cutoff and are
    merged by ``trade_key`` (``row_pos`` orders each tier), candles as :func:`route_candles` decides;
    these have ``ticker``, ``end_period_ts`` and ``row_pos`` beside ``id`` and ``ts``; ``archived_markets`` names
    the markets (``ticker``) known to be archived, by default those with any archived candle. Trades, points
    and candles are in time order within a contract.

    An id may hold a large part of a table, so the joins spread such an id over many tasks. The choice and
    the ids are written once, because every dataset starts from them.
    """
    chosen, notice = select_contracts(rows, max_markets, pos)
    chosen = stored(chosen)
    pair = ["platform", "market_id"]
    # Without a limit every identified contract is chosen and no row needs to be looked up.
    universe = rows.dropna(subset=pair) if max_markets is None else rows.join(chosen.select(*pair), pair, "left_semi")
    wanted = sorted({d for venue in tables.values() for d in venue})
    routed = dataset_routes(universe, wanted, pos)
    routes = stored(routed["routes"])
    out = {"contracts": chosen, "notice": notice, "errors": routed["errors"], "warnings": routed["warnings"]}
    spark = rows.sparkSession
    bounded_range = start is not None or end is not None or run_epoch is not None
    if bounded_range:
        asked = F.lit(start).cast("bigint"), F.lit(end).cast("bigint"), F.lit(run_epoch).cast("bigint")
        start, end = spark.range(1).select(*default_range(*asked)).first()
    for venue, venue_tables in tables.items():
        for dataset, table in venue_tables.items():
            archive = (archives or {}).get(venue, {}).get(dataset)
            timed = dataset in ("trades", "history")
            keys = routes.filter((F.col("platform") == venue) & (F.col("dataset") == dataset)).drop("id_kind", "dataset").distinct()
            candle = dataset == "history" and "end_period_ts" in table.columns
            if candle and archive is not None:
                # A market is archived or not whatever candles it has in the range.
                archived = (archived_markets or {}).get(venue, archive).select("ticker")
            if timed and bounded_range:
                span = (F.col("ts") >= start) & ((F.col("ts") <= end) if candle else (F.col("ts") < end))
                table, archive = table.filter(span), None if archive is None else archive.filter(span)
            spread = F.col("ts") if timed and "ts" in table.columns else F.xxhash64(*[c for c in table.columns if c != "id"])
            own = salted_join(table, keys, ["id"], spread)
            if archive is not None and candle and bounded_range:
                own = route_candles(own, salted_join(archive, keys, ["id"], spread), archived, start, end, period_minutes * 60 * CANDLES_PER_REQUEST)
            elif archive is not None and cutoffs is not None and bounded_range:
                venues = spark.createDataFrame([(venue, start)], "platform STRING, start_ts BIGINT")
                if trade_tiers(venues, cutoffs).first()["reads_archive"]:
                    own = merge_latest(own, salted_join(archive, keys, ["id"], spread), [*pair, "trade_key"]).drop("first_tier", "first_pos")
            out[f"{venue}_{dataset}"] = in_time_order(own, pair, "ts") if timed and "ts" in own.columns else own
    return out
