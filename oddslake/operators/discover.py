"""Discovery over landed events and series: selection, ranking, closeness and coverage.

Parents carry their children as nested JSON; exploding them keeps the parent columns on each
row, so market and event never need a join. Candidates are made unique before any label is
computed, because labels are the expensive part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddslake.functions import (
    computed,
    first_present,
    json_list,
    json_objects,
    latest_by,
    number,
    truthy,
)
from oddslake.operators.normalize import normalize_candidates
from oddslake.operators.topics import ELECTION_TOPIC, classify, select_topics
from oddslake.session import stored
from oddslake.sources.taxonomy import Taxonomy

# Hosts whose settlement data marks a series as a United States one, and the
# sentence added for them.
OFFICIAL_US_HOSTS = [
    "bls.gov", "bea.gov", "census.gov", "federalreserve.gov", "congress.gov", "senate.gov",
    "house.gov", "fec.gov",
]
OFFICIAL_NOTE = " United States official settlement source "
# Patterns of the series gate, the series families and the cycle evidence.
FOREIGN_TAG = r"(?iu)international|foreign"
ELECTION_FAMILY = r"(?iuUd)\b(?:house|senate|congressional|governor|gubernatorial|midterms?|redistricting|generic ballot)\b"
ELECTION_CONTEXT = r"(?iuUd)US Elections|midterms?|\b(?:house|senate)\b.*\b(?:control|winner|election|race)\b"
CHAMBER_CONTROL = r"(?iuUd)^(?:US\s+|U\.S\.\s+)?(?:House(?: of Representatives)?|Senate)\s+(?:winner|control)\z"
RACE_WINNER = r"(?iuUd)^(?:House|Senate)\s+Race\s+Winner\z"
RELATED_RACE = r"(?iuUd)\b(?:primary|primaries|nominee|nomination|combo|endorse|runoff|resign|expel)\b"
CYCLE_TICKER = r"-(?:26|2026)$"
CHAMBER_RULE = r"(?iuUd)\b(?:House member|Senat(?:e|or)|Congress)\b"
TERM_RULE = r"(?iuUd)\bterm\s+(?:beginning|starting)\s+(?:in\s+)?2027\b"
CYCLE_BASIS = "Election ticker suffix and congressional term beginning in 2027"
CYCLE_CONTEXT = "2026 congressional election cycle inferred from ticker and term rules."
# The warnings of discovery.
SERIES_LIMITED = "Kalshi series limited to %d of %d matches; increase --max-series"
SERIES_ABSENT = "Requested series absent from catalog: "
ARCHIVED_LEFT_OUT = "Nested Kalshi events exclude archived markets. Use historical discovery/GET for pre-cutoff markets."
QUERY_STOP_WORDS = ["the", "will", "who", "and", "for", "united", "states"]


def query_words(queries: Sequence[str]) -> list[str]:
    """Lower-cased words of three or more letters, without stop words."""
    words = {w.lower() for q in queries for w in re.findall(r"[a-zA-Z]+", q) if len(w) > 2}
    return sorted(words - set(QUERY_STOP_WORDS))


def query_match(text: Column, queries: Sequence[str] | None) -> Column:
    """True where any query word occurs as a whole word; no queries match everything."""
    if not queries:
        return F.lit(True)
    words = query_words(queries)
    return text.rlike(rf"(?iuU)\b(?:{'|'.join(words)})\b") if words else F.lit(False)


def _quoted(tag: Column) -> Column:
    """A tag in single quotes, in double ones where it holds an apostrophe only."""
    plain = F.replace(F.replace(tag, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    double = F.contains(tag, F.lit("'")) & ~F.contains(tag, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), tag, F.lit('"'))).otherwise(F.concat(F.lit("'"), plain, F.lit("'")))


def series_context(series: DataFrame, out: str = "context") -> DataFrame:
    """Add the text a series is classified by, with a note for an official US settlement source."""
    host = lambda s: F.regexp_replace(F.lower(F.try_parse_url(s["url"], F.lit("HOST"))), r"^www\.", "")
    official = rf"(?:^|\.)(?:{'|'.join(re.escape(h) for h in OFFICIAL_US_HOSTS)})$"
    first = F.get(F.filter("settlement_sources", lambda s: F.coalesce(host(s).rlike(official), F.lit(False))), 0)
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("["), F.array_join(F.transform("tags", _quoted), ", "), F.lit("]")))
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (F.col("title"), F.col("ticker"), F.col("category"), tags)])
    note = F.when(first.isNotNull(), F.concat(F.lit(OFFICIAL_NOTE), F.coalesce(first["name"], F.lit("")))).otherwise(F.lit(""))
    return series.withColumn(out, F.concat(text, note))


def midterm_series(context: Column, exclude_reason: Column) -> Column:
    """Coarse election gate of a series; the event must still prove its cycle."""
    tags = F.coalesce(F.array_join("tags", " "), F.lit(""))
    title = F.coalesce("title", F.lit(""))
    blocked = exclude_reason.isin("sports_context", "foreign_context_without_explicit_us_link")
    election = (F.lower(F.coalesce("category", F.lit(""))) == "elections") | context.rlike(ELECTION_CONTEXT)
    return ~tags.rlike(FOREIGN_TAG) & ~F.coalesce(blocked, F.lit(False)) & title.rlike(ELECTION_FAMILY) & election


def series_priority(title: Column, volume: Column, candidate: Column) -> Column:
    """0 not an election, 1 unused template, 6 chamber control, 5 race winner, 2 related, else 4."""
    title = F.rtrim(F.trim(F.coalesce(title, F.lit(""))), F.lit("?"))
    return (
        F.when(~candidate, 0)
        .when(volume == 0, 1)
        .when(title.rlike(CHAMBER_CONTROL), 6)
        .when(title.rlike(RACE_WINNER), 5)
        .when(title.rlike(RELATED_RACE), 2)
        .otherwise(4)
    )


def matching_series(
    series: DataFrame,
    taxonomy: Taxonomy | None = None,
    *,
    topics: Sequence[str] | None = None,
    queries: Sequence[str] | None = None,
    series_tickers: Sequence[str] | None = None,
) -> DataFrame:
    """Series admitted by label, election gate, query words or an explicit list, with priority."""
    labelled = classify(series_context(series), "context", taxonomy).withColumn(
        "midterm_candidate", midterm_series(F.col("context"), F.col("exclude_reason"))
    )
    election_wanted = not topics or ELECTION_TOPIC in topics
    chosen = F.size("topics") > 0
    if topics:
        chosen = chosen & F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics]))
    if election_wanted:
        chosen = chosen | F.col("midterm_candidate")
    if series_tickers:
        admitted = F.col("ticker").isin(*series_tickers)
    else:
        admitted = chosen & query_match(F.col("context"), queries)
    volume = number(first_present(F.col("volume_fp"), F.col("volume")))
    priority = series_priority(F.col("title"), volume, F.col("midterm_candidate")) if election_wanted else F.lit(0)
    return labelled.filter(admitted).withColumn("priority", priority)


def rank_series(matching: DataFrame, limit: int | None = None) -> DataFrame:
    """Series by priority, relevance, volume, then ticker; with a limit a distributed top-k."""
    volume = F.coalesce(number(F.col("volume_fp")), F.lit(0.0))
    order = [F.col("priority").desc(), F.col("relevance_score").desc(), volume.desc(), F.coalesce("ticker", F.lit(""))]
    ranked = matching.orderBy(*order)
    return ranked if limit is None else ranked.limit(limit)


def absent_series(series: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Requested tickers that the catalogue does not hold."""
    wanted = series.sparkSession.createDataFrame([(t,) for t in requested], "ticker STRING").distinct()
    # The request list is an argument; only rows that match it leave the catalogue scan.
    held = series.filter(F.col("ticker").isin(*requested)).select("ticker").distinct()
    return wanted.join(held, "ticker", "left_anti").orderBy("ticker")


def cycle_evidence(event_ticker: Column, markets: Column) -> Column:
    """Struct with year, rule and basis when ticker suffix and a market's rule both show the cycle."""
    rule = lambda m: F.coalesce(F.get_json_object(m, "$.rules_primary"), F.lit(""))
    proof = F.get(F.filter(markets, lambda m: rule(m).rlike(CHAMBER_RULE) & rule(m).rlike(TERM_RULE)), 0)
    found = event_ticker.rlike(CYCLE_TICKER) & proof.isNotNull()
    return F.when(
        found,
        F.struct(
            F.lit(2026).alias("year"), event_ticker.alias("event_ticker"), rule(proof).alias("rule"), F.lit(CYCLE_BASIS).alias("basis")
        ),
    )


def well_quoted_distance(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    """|midpoint - 0.5| of a market quoted within 0.15 on both sides, else null."""
    sized = F.coalesce(bid_size != 0, F.lit(True)) & F.coalesce(ask_size != 0, F.lit(True))
    quoted = (bid >= 0) & (bid <= ask) & (ask <= 1) & (ask - bid <= 0.15)
    return F.when(quoted & sized, F.abs((bid + ask) / 2 - 0.5))


def event_closeness(markets: DataFrame, keys: Sequence[str] = ("event_ticker",)) -> DataFrame:
    """Per event the closest well-quoted market and the 24h volume, closest races first.

    ``markets`` has bid, ask, bid_size, ask_size and volume_24h; partial aggregation leaves one
    row per event and task, however many markets an event holds.
    """
    distance = well_quoted_distance(F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("ask_size"))
    per_event = markets.groupBy(*keys).agg(
        F.min(distance).alias("distance"), F.sum(F.coalesce("volume_24h", F.lit(0.0))).alias("volume_24h")
    )
    ranked = per_event.withColumn("unquoted", F.when(F.col("distance").isNull(), 1).otherwise(0))
    return ranked.orderBy("unquoted", F.coalesce("distance", F.lit(1.0)), F.col("volume_24h").desc(), *keys)


def event_priority(markets: Column) -> Column:
    """(unquoted, distance, -volume) of one event from its nested market JSON array."""

    def facts(market: Column) -> Column:
        q = quote_columns(market)
        distance = well_quoted_distance(q["bid"], q["ask"], q["bid_size"], q["ask_size"])
        return F.struct(distance.alias("distance"), F.coalesce(q["volume_24h"], F.lit(0.0)).alias("volume"))

    rows = F.transform(markets, facts)
    nearest = F.array_min(F.transform(rows, lambda r: r["distance"]))
    volume = F.aggregate(rows, F.lit(0.0), lambda total, r: total + r["volume"])
    return F.struct(
        F.when(nearest.isNull(), 1).otherwise(0).alias("unquoted"),
        F.coalesce(nearest, F.lit(1.0)).alias("distance"),
        (-F.coalesce(volume, F.lit(0.0))).alias("volume"),
    )


QUOTE_FIELDS = [
    *[f"{side}{suffix}" for side in ("yes_bid", "yes_ask") for suffix in ("_dollars", "", "_size_fp", "_size")], "volume_24h_fp", "volume_24h",
]


def with_quotes(markets: DataFrame, market: str = "market", more: Sequence[str] = ()) -> DataFrame:
    """Add the columns of :func:`quote_columns` and the text of ``more`` fields; each market is parsed once."""
    fields = [*QUOTE_FIELDS, *[f for f in more if f not in QUOTE_FIELDS]]
    told = markets.select("*", F.json_tuple(market, *fields).alias(*[f"__{f}" for f in fields]))
    keyed = computed(told, __keys=F.json_object_keys(market))
    quotes = _quotes(F.col("__keys"), lambda k: number(F.col(f"__{k}")))
    return keyed.select(*markets.columns, *[c.alias(n) for n, c in quotes.items()], *[F.col(f"__{f}").alias(f) for f in more])


def quote_columns(market: Column | str = "market") -> dict[str, Column]:
    """Columns :func:`event_closeness` needs, read from raw Kalshi market JSON."""
    return _quotes(F.json_object_keys(market), lambda k: number(F.get_json_object(market, f"$.{k}")))


def _quotes(keys: Column, value: Callable[[str], Column]) -> dict[str, Column]:

    def price(field: str) -> Column:
        present = F.array_contains(keys, f"{field}_dollars")
        return F.when(present, value(f"{field}_dollars")).otherwise(value(field) / 100)

    def either(preferred: str, other: str) -> Column:
        return F.when(F.array_contains(keys, preferred), value(preferred)).otherwise(value(other))

    return {
        "bid": price("yes_bid"),
        "ask": price("yes_ask"),
        "bid_size": either("yes_bid_size_fp", "yes_bid_size"),
        "ask_size": either("yes_ask_size_fp", "yes_ask_size"),
        "volume_24h": either("volume_24h_fp", "volume_24h"),
    }


def without_markets(event: Column) -> Column:
    """Event JSON without its child markets, so a candidate does not carry its siblings."""
    entries = F.from_json(event, "map<string,variant>")
    return F.to_json(F.map_filter(entries, lambda k, _: k != "markets"))


def with_fields(event: Column, fields: dict[str, Column]) -> Column:
    """Event JSON with some text fields replaced or added; null values are left out."""
    entries = F.from_json(event, "map<string,variant>")
    kept = F.map_filter(entries, lambda k, _: ~k.isin(*fields))
    added = F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])), "map<string,variant>")
    return F.to_json(F.map_concat(kept, added))


def explode_markets(events: DataFrame, event: str = "event", pos: str = "row_pos") -> DataFrame:
    """One row per child market: ``market`` JSON, its event without markets, and its position."""
    keep = [c for c in events.columns if c not in (event, pos)]
    children = F.filter(
        F.coalesce(F.from_json(event, "markets ARRAY<STRING>")["markets"], F.array().cast("array<string>")),
        lambda m: m.startswith("{"),
    )
    return events.select(
        *keep, pos, without_markets(F.col(event)).alias("event"), F.posexplode(children).alias("market_pos", "market")
    )


def open_markets(candidates: DataFrame, include_closed: bool = False) -> DataFrame:
    """Polymarket rows that are not closed, Kalshi rows whose status is active or open."""
    if include_closed:
        return candidates
    closed = F.coalesce(F.get_json_object("market", "$.closed"), F.lit("false"))
    status = F.coalesce(F.get_json_object("market", "$.status"), F.lit(""))
    is_open = F.when(F.col("platform") == "polymarket", closed.isin("false", "0", "")).otherwise(
        status.isin("active", "open")
    )
    return candidates.filter(is_open)


def unique_candidates(candidates: DataFrame, pos: Column | None = None) -> DataFrame:
    """First candidate per venue and market id; rows without an id are dropped."""
    pos = F.col("row_pos") if pos is None else pos
    id_path = F.when(F.col("platform") == "polymarket", F.get_json_object("market", "$.id")).otherwise(
        F.get_json_object("market", "$.ticker")
    )
    identified = candidates.withColumn("candidate_id", id_path).filter(
        ~F.coalesce("candidate_id", F.lit("")).isin("", "None")
    )
    return latest_by(identified, ["platform", "candidate_id"], pos, "first")


def coverage_counts(candidates: DataFrame, labelled: DataFrame, topics: Sequence[str] | None = None) -> DataFrame:
    """Per venue: candidate markets, selected outcome rows and markets without a selected row."""
    selected = select_topics(labelled, topics)
    ids = candidates.select("platform", F.col("candidate_id").alias("market_id"))
    rows = selected.groupBy("platform", "market_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        ids.join(rows, ["platform", "market_id"], "left")
        .groupBy("platform")
        .agg(
            F.count(F.lit(1)).alias("candidate_markets"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("selected_outcome_rows"),
            F.count_if(F.col("n").isNull()).alias("unclassified_markets"),
        )
    )


def selectable_markets(markets: DataFrame, market: str = "market") -> DataFrame:
    """Polymarket markets accepting orders, with an order book, a condition id and tokens."""
    field = lambda k: F.get_json_object(market, f"$.{k}")
    return markets.filter(
        (field("acceptingOrders") == "true")
        & (field("enableOrderBook") == "true")
        & truthy(field("conditionId")).isNotNull()
        & (F.size(json_list(field("clobTokenIds"))) > 0)
    )


def sample_market(markets: DataFrame, pos: Column, market: str = "market") -> DataFrame:
    """The one market with balanced displayed prices and the largest 24h volume, first on ties."""
    prices = F.transform(json_list(F.get_json_object(market, "$.outcomePrices")), lambda p: p.try_cast("double"))
    balanced = (F.size(prices) == 2) & F.forall(prices, lambda p: (p > 0.10) & (p < 0.90))
    volume = F.coalesce(number(F.get_json_object(market, "$.volume24hr")), F.lit(0.0))
    return markets.orderBy(balanced.desc(), volume.desc(), pos).limit(1)


def largest_volume(markets: DataFrame, volume: Column, pos: Column) -> DataFrame:
    """The row of largest volume, first on ties."""
    return markets.orderBy(F.coalesce(volume, F.lit(0.0)).desc(), pos).limit(1)


def ordered_unique(rows: DataFrame, column: str, pos: Column) -> DataFrame:
    """Distinct values in first-seen order."""
    return rows.groupBy(column).agg(F.min(pos).alias("first_pos")).orderBy("first_pos")


def interleave(contracts: DataFrame, limit: int, pos: str = "first_pos") -> DataFrame:
    """Round-robin over venues in first-seen order, cut at ``limit`` contracts.

    ``pos`` is any orderable position. A venue cannot place more than ``limit`` contracts, so its
    turns are a rank under a bound: tasks drop what lies beyond it before the venues meet.
    """
    turns = contracts.withColumn("turn", F.row_number().over(W.partitionBy("platform").orderBy(pos)))
    leading = turns.filter(F.col("turn") <= limit)
    venue_first = F.min(pos).over(W.partitionBy("platform"))
    return leading.withColumn("venue_first", venue_first).orderBy("turn", "venue_first").limit(limit)


def discover(
    polymarket_events: DataFrame | None,
    kalshi_series: DataFrame | None,
    kalshi_events: DataFrame | None,
    taxonomy: Taxonomy | None = None,
    *,
    queries: Sequence[str] | None = None,
    topics: Sequence[str] | None = None,
    max_series: int | None = None,
    include_closed: bool = False,
    series_tickers: Sequence[str] | None = None,
    run_time: Column | None = None,
) -> dict[str, DataFrame]:
    """Landed events and series to candidates, labelled outcome rows, coverage, counters and warnings.

    Event tables hold raw ``event`` JSON with nested markets, ``observed_at`` and a BIGINT
    ``row_pos``; Kalshi events also carry ``series_ticker``. In the results ``row_pos`` is the
    discovery order as an orderable struct; ``with_row_pos`` turns it into a number when the
    table is written. Labelled series, unique candidates and labelled rows are written once, as
    several results start from each of them. ``counters`` has one row per name; ``warnings`` tells of
    series beyond ``max_series``, requested series that are not in the catalogue, and, with closed
    markets, of archived ones that nested events leave out.
    """
    taxonomy = taxonomy or Taxonomy.default()
    taxonomy.check_topics(topics)
    parts, result, counters, warnings = [], {}, [], []
    if polymarket_events is not None:
        children = explode_markets(polymarket_events.select("event", "observed_at", "row_pos"))
        parts.append(
            children.select(
                F.lit("polymarket").alias("platform"), "market", "event", "observed_at",
                F.struct(F.lit(0).alias("source"), _plain_rank(F.col("row_pos")).alias("parent"), "market_pos").alias("row_pos"),
            )
        )
        ids = polymarket_events.select(F.get_json_object("event", "$.id").alias("event_id"))
        counters.append(ids.agg(F.countDistinct("event_id").alias("n")).select(F.lit("polymarket_events").alias("counter"), "n"))
    if kalshi_series is not None and kalshi_events is not None:
        matching = stored(
            matching_series(kalshi_series, taxonomy, topics=topics, queries=queries, series_tickers=series_tickers)
        )
        selected = rank_series(matching, max_series)
        found = matching.agg(F.count(F.lit(1)).alias("n"))
        counters.append(found.select(F.lit("kalshi_series_matching").alias("counter"), "n"))
        counters.append(selected.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kalshi_series_selected").alias("counter"), "n"))
        if max_series is not None:
            warnings.append(found.filter(F.col("n") > max_series).select(F.format_string(SERIES_LIMITED, F.lit(max_series), F.col("n")).alias("warning")))
        if include_closed:
            warnings.append(found.select(F.lit(ARCHIVED_LEFT_OUT).alias("warning")))
        result["series_selected"] = selected.select("ticker", "title", "priority", "relevance_score", "context")
        if series_tickers:
            result["series_absent"] = absent_series(kalshi_series, series_tickers)
            # The request is an argument, so its list is as long as the caller made it.
            listed = F.array_join(F.array_sort(F.collect_list("ticker")), ", ")
            missing = result["series_absent"].agg(listed.alias("listed")).filter("listed <> ''")
            warnings.append(missing.select(F.concat(F.lit(SERIES_ABSENT), "listed").alias("warning")))
        parents = kalshi_events.join(
            selected.select(
                F.col("ticker").alias("series_ticker"), F.col("title").alias("__series_title"), "context",
                F.col("priority").alias("__p"), F.col("relevance_score").alias("__r"),
                F.coalesce(number(F.col("volume_fp")), F.lit(0.0)).alias("__v"),
            ),
            "series_ticker",
        )
        counted = kalshi_events.join(selected.select(F.col("ticker").alias("series_ticker")), "series_ticker", "left_semi")
        counters.append(counted.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kalshi_events").alias("counter"), "n"))
        parts.append(_kalshi_children(parents))
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    unique = stored(unique_candidates(open_markets(candidates, include_closed)))
    labelled = stored(normalize_candidates(unique, taxonomy, run_time))
    result["candidates"] = unique
    result["markets"] = select_topics(labelled, topics)
    result["coverage"] = coverage_counts(unique, labelled, topics)
    for name, rows in (("candidate_markets", unique), ("selected_outcome_rows", result["markets"])):
        counters.append(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n"))
    result["counters"] = reduce(DataFrame.unionByName, counters)
    none = unique.sparkSession.createDataFrame([], "warning STRING")
    result["warnings"] = reduce(DataFrame.unionByName, warnings, none)
    return result


def _plain_rank(pos: Column) -> Column:
    """Parent rank of an event that has no series: its position alone."""
    nothing = F.struct(
        F.lit(0).alias("unquoted"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("volume")
    )
    return F.struct(
        F.lit(0).alias("priority"), F.lit(0).alias("relevance"), F.lit(0.0).alias("volume"), F.lit("").alias("ticker"),
        nothing.alias("closeness"), pos.alias("pos"),
    )


def _kalshi_children(parents: DataFrame) -> DataFrame:
    """Child markets of selected events, with series context and cycle evidence injected."""
    markets = json_objects(F.get_json_object("event", "$.markets"))
    evidence = cycle_evidence(F.coalesce(F.get_json_object("event", "$.event_ticker"), F.lit("")), markets)
    description = F.concat_ws(" ", F.coalesce(F.get_json_object("event", "$.description"), F.lit("")), F.col("context"))
    enriched = parents.withColumn("__cycle", evidence).withColumn(
        "event",
        with_fields(
            F.col("event"),
            {
                "description": description,
                "series_title": F.col("__series_title"),
                "series_ticker": F.col("series_ticker"),
                "series_context": F.when(F.col("__cycle").isNotNull(), F.lit(CYCLE_CONTEXT)).otherwise(
                    F.get_json_object("event", "$.series_context")
                ),
                "derived_election_cycle": F.col("__cycle.year"),
                "derived_election_cycle_evidence": F.when(
                    F.col("__cycle").isNotNull(), F.struct("__cycle.event_ticker", "__cycle.rule", "__cycle.basis")
                ),
            },
        ),
    )
    rank = F.struct(
        (-F.col("__p")).alias("priority"), (-F.col("__r")).alias("relevance"), (-F.col("__v")).alias("volume"),
        F.col("series_ticker").alias("ticker"), event_priority(markets).alias("closeness"), F.col("row_pos").alias("pos"),
    )
    children = explode_markets(enriched.withColumn("__rank", rank))
    return children.select(
        F.lit("kalshi").alias("platform"), "market", "event", "observed_at",
        F.struct(F.lit(1).alias("source"), F.col("__rank").alias("parent"), "market_pos").alias("row_pos"),
    )
