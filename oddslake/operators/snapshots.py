"""Snapshot comparison: changes, skipped comparisons, watchlist and coverage differences.

A snapshot is a table of outcome rows. Identity is (platform, market_id, outcome), with null
read as empty text. Both sides are first reduced to one row per identity by an aggregate that
also counts copies, so a market that is repeated many times collapses before any shuffle; the
join is then one-to-one on the identity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.functions import exact, finite, instant, latest_by, valid_probability
from oddslake.session import stored

KEY = ["k_platform", "k_market_id", "k_outcome"]
IDENTITY = ["platform", "market_id", "event_id", "title", "outcome", "token_id", "topics"]
# Review thresholds, topics that are not issue evidence, report caveats.
MINIMUM_MOVE_PP = 3.0
WIDE_SPREAD = 0.10
THIN_VOLUME = {"polymarket": 1000.0, "kalshi": 1000.0}
BASE_TOPICS = ["midterms_2026", "us_politics", "us_macro", "fed_monetary_policy"]
MIDTERM_REASON = "2026_midterm_exposure"
INTERPRETATION = [
    "Prices are market-implied estimates; watchlist entries are research leads, not forecasts of stock returns.",
    "Keyword and sector links are hypotheses requiring verification against resolution rules, campaign statements "
    "and policy documents.",
    "New or disappeared coverage may reflect query limits, listing changes, pagination or collection errors; it does "
    "not establish public attention or traction.",
    "Do not add, average or volume-weight heterogeneous market probabilities. Volume units differ between venues.",
    "No cross-venue equivalence or arbitrage is inferred; compare resolution wording, timing, fees and executable "
    "depth manually.",
    "A shift in political probability alone does not identify a policy's causal effect on equities. Missing issue "
    "markets are coverage gaps, not zero probabilities.",
]

_PREVIOUS_FIELDS = ["token_id", "title", "rules", "probability", "price_source", "observed_at"]
_CURRENT_FIELDS = [
    "platform", "market_id", "event_id", "title", "outcome", "token_id", "topics", "rules", "probability",
    "price_source", "observed_at", "bid", "ask", "spread", "volume", "volume_unit", "sectors", "matched_terms",
    "quality_flags", "row_pos",
]
_OPTIONAL = {
    "event_id": "string", "token_id": "string", "topics": "array<string>", "bid": "double", "ask": "double",
    "spread": "double", "volume": "double", "volume_unit": "string", "sectors": "array<string>",
    "matched_terms": "map<string,array<string>>", "quality_flags": "array<string>", "title": "string",
    "rules": "string", "probability": "double", "price_source": "string", "observed_at": "string",
}


def with_key(rows: DataFrame) -> DataFrame:
    """Add the three identity columns; null and missing read as empty text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.withColumns(dict(zip(KEY, (text("platform"), text("market_id"), text("outcome")))))


def _filled(rows: DataFrame, wanted: list[str]) -> DataFrame:
    missing = {c: F.lit(None).cast(_OPTIONAL[c]) for c in wanted if c not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def latest_snapshot(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per identity: the last by ``row_pos``, with ``copies`` and the first position.

    ``row_pos`` may be any orderable column, a struct included, that is unique per identity.
    """
    return _latest(rows, fields or [c for c in _CURRENT_FIELDS if c in rows.columns])


def _latest(rows: DataFrame, fields: list[str], more: Mapping[str, Column] | None = None) -> DataFrame:
    keyed = with_key(_filled(rows, fields)).select(*KEY, F.col("row_pos").alias("__pos"), *fields)
    return latest_by(keyed, KEY, F.col("__pos"), "last", "copies", "first_pos", more, ["__pos"])


def duplicate_identities(rows: DataFrame) -> DataFrame:
    """Identities that occur more than once, with their number of copies."""
    return with_key(rows).groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def _has_identity() -> Column:
    return (F.col("k_platform") != "") & (F.col("k_market_id") != "")


def _present(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def compare(
    current: DataFrame,
    previous: DataFrame | None = None,
    *,
    wide_spread: float = WIDE_SPREAD,
    thin_volume: Mapping[str, float] | None = None,
) -> DataFrame:
    """Current identities with their previous observation, quality flags and comparability.

    ``invalid_reason`` names the first failed check, ``change_pp`` is set only where every
    check passed. Write this table once when several reports are derived from it.
    """
    cur = latest_snapshot(current, _CURRENT_FIELDS)
    if previous is None:
        nothing = {f"prev_{c}": F.lit(None).cast(_OPTIONAL[c]) for c in _PREVIOUS_FIELDS}
        joined = cur.withColumns({**nothing, "prev_copies": F.lit(None).cast("bigint")})
    else:
        prev = latest_snapshot(previous, _PREVIOUS_FIELDS).drop("first_pos")
        renamed = prev.select(*KEY, *[F.col(c).alias(f"prev_{c}") for c in [*_PREVIOUS_FIELDS, "copies"]])
        joined = cur.join(renamed, KEY, "left")
    return _judged(joined, wide_spread, thin_volume)


def _judged(
    joined: DataFrame, wide_spread: float, thin_volume: Mapping[str, float] | None, more: Sequence[Column] = ()
) -> DataFrame:
    """Current rows beside their ``prev_`` columns to flags, comparability and change, with ``more`` columns."""
    limits = dict(thin_volume or THIN_VOLUME)
    limit = F.lit(None).cast("double")
    for venue, value in limits.items():
        limit = F.when(F.col("k_platform") == venue, F.lit(float(value))).otherwise(limit)
    estimate, spread, volume = valid_probability(F.col("probability")), finite(F.col("spread")), finite(F.col("volume"))
    duplicated = (F.col("copies") > 1) | (F.coalesce(F.col("prev_copies"), F.lit(0)) > 1)
    added_flags = F.array_compact(
        F.array(
            F.when(spread >= F.lit(float(wide_spread)), F.lit("wide_spread")),
            F.when(volume < limit, F.lit("low_cumulative_volume")),
            F.when(estimate.isNull(), F.lit("missing_probability")),
            F.when(duplicated, F.lit("duplicate_snapshot_identity")),
        )
    )
    no_flags = F.array().cast("array<string>")
    now, then = instant(F.col("observed_at")), instant(F.col("prev_observed_at"))
    before = valid_probability(F.col("prev_probability"))
    same_contract = F.lit(True)
    for field in ("token_id", "title", "rules"):
        same_contract = same_contract & F.col(field).eqNullSafe(F.col(f"prev_{field}"))
    matched = F.col("prev_copies").isNotNull() & _has_identity()
    invalid = (
        F.when(~_has_identity(), F.lit("missing_stable_market_identity"))
        .when(~matched, F.lit(None).cast("string"))
        .when(duplicated, F.lit("duplicate_snapshot_identity"))
        .when(~F.coalesce(now > then, F.lit(False)), F.lit("missing_or_nonincreasing_observation_time"))
        .when(estimate.isNull() | before.isNull(), F.lit("missing_valid_price"))
        .when(
            ~_present("price_source") | ~F.col("price_source").eqNullSafe(F.col("prev_price_source")),
            F.lit("price_source_changed_or_missing"),
        )
        .when(~same_contract, F.lit("contract_definition_changed"))
    )
    return joined.select(
        *KEY,
        *[F.col(c) for c in IDENTITY],
        estimate.alias("probability"),
        before.alias("previous_probability"),
        F.col("bid"),
        F.col("ask"),
        spread.alias("spread"),
        volume.alias("volume"),
        F.col("volume_unit"),
        F.col("sectors"),
        F.col("matched_terms"),
        F.col("price_source"),
        F.col("observed_at"),
        F.col("prev_observed_at").alias("previous_observed_at"),
        F.array_sort(F.array_union(F.coalesce("quality_flags", no_flags), added_flags)).alias("quality_flags"),
        matched.alias("matched"),
        invalid.alias("invalid_reason"),
        F.when(
            matched & invalid.isNull(), ((exact(estimate) - exact(before)) * F.lit(100)).cast("double")
        ).alias("change_pp"),
        F.col("copies"),
        F.col("first_pos"),
        *more,
    )


def _sorted(rows: DataFrame, ordered: bool, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order) if ordered else rows


def changes(compared: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Comparable identities, largest absolute move first."""
    return _sorted(compared.filter(F.col("change_pp").isNotNull()), ordered, F.abs("change_pp").desc(), "first_pos").select(
        *IDENTITY, "previous_probability", "probability", "change_pp", "previous_observed_at", "observed_at",
        "price_source", "quality_flags",
    )


def skipped_comparisons(compared: DataFrame) -> DataFrame:
    """Identities left out of the comparison, with the first failed check."""
    return compared.filter(F.col("invalid_reason").isNotNull()).select(*IDENTITY, F.col("invalid_reason").alias("reason"))


def review_reasons(minimum_move_pp: float, comparison_requested: bool) -> Column:
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    issues = F.array_except(topics, F.array(*[F.lit(t) for t in BASE_TOPICS]))
    return F.array_compact(
        F.array(
            F.when(F.abs("change_pp") >= F.lit(float(minimum_move_pp)), F.lit("price_move_requires_review")),
            F.when(F.lit(comparison_requested) & ~F.col("matched"), F.lit("new_in_collected_coverage")),
            F.when(F.array_contains(topics, BASE_TOPICS[0]), F.lit(MIDTERM_REASON)),
            F.when(F.size(issues) > 0, F.lit("investment_issue_keyword_evidence")),
        )
    )


def watchlist(
    compared: DataFrame,
    *,
    minimum_move_pp: float = MINIMUM_MOVE_PP,
    comparison_requested: bool = True,
    ordered: bool = True,
) -> DataFrame:
    """Rows with a reason or a topic: midterm rows first, then by absolute move."""
    labelled = compared.filter(_has_identity()).withColumn(
        "reasons", review_reasons(minimum_move_pp, comparison_requested)
    )
    default = F.array(F.lit("target_topic_coverage"))
    kept = labelled.filter((F.size("reasons") > 0) | (F.coalesce(F.size("topics"), F.lit(0)) > 0))
    order = F.array_contains("reasons", MIDTERM_REASON).desc(), F.coalesce(F.abs("change_pp"), F.lit(0.0)).desc(), "first_pos"
    return _sorted(kept, ordered, *order).select(
        *IDENTITY,
        "probability",
        "change_pp",
        "bid",
        "ask",
        "spread",
        "volume",
        "volume_unit",
        F.coalesce("sectors", F.array().cast("array<string>")).alias("sectors"),
        F.coalesce("matched_terms", F.create_map().cast("map<string,array<string>>")).alias("matched_terms"),
        "price_source",
        "observed_at",
        F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(default).alias("reasons"),
        "quality_flags",
    )


def coverage_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Identities of ``left`` absent from ``right``, ordered by identity.

    The right side carries only its distinct keys, so its scan stays narrow and copies of one
    identity collapse before the shuffle.
    """
    ours = latest_snapshot(left, IDENTITY)
    theirs = with_key(right).select(*KEY).distinct()
    return ours.join(theirs, KEY, "left_anti").orderBy(*KEY).select(*IDENTITY)


def topic_market_counts(rows: DataFrame) -> DataFrame:
    """Distinct markets per topic over the latest row of each identity, ordered by topic."""
    return _topic_counts(latest_snapshot(rows, ["platform", "market_id", "topics"]))


def _topic_counts(latest: DataFrame, ordered: bool = True) -> DataFrame:
    counts = (
        latest.filter(_has_identity()).select("k_platform", "k_market_id", F.explode("topics").alias("topic"))
        .groupBy("topic")
        .agg(F.countDistinct("k_platform", "k_market_id").alias("markets"))
    )
    return _sorted(counts, ordered, "topic")


def time_range(rows: DataFrame) -> DataFrame:
    """Earliest and latest parseable observation instant."""
    at = instant(F.col("observed_at"))
    return rows.agg(_instant_text(F.min(at)).alias("earliest"), _instant_text(F.max(at)).alias("latest"))


def _instant_text(at: Column) -> Column:
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return F.regexp_replace(F.regexp_replace(iso, "Z$", "+00:00"), r"\.000000", "")


def new_markets(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(platform, market) pairs of identified current rows not seen in the previous snapshot."""
    pair = KEY[:2]
    ours = with_key(current).filter(_has_identity()).select(*pair).distinct()
    return ours.join(with_key(previous).select(*pair).distinct(), pair, "left_anti")


def _one_row(pieces: list[DataFrame]) -> DataFrame:
    """Put single-row aggregates side by side: stack them, then take the one value per column."""
    names = [c for piece in pieces for c in piece.columns]
    stacked = pieces[0]
    for piece in pieces[1:]:
        stacked = stacked.unionByName(piece, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def summary(
    current: DataFrame,
    previous: DataFrame | None = None,
    *,
    minimum_move_pp: float = MINIMUM_MOVE_PP,
    wide_spread: float = WIDE_SPREAD,
    thin_volume: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row: outcome and market counts, new markets, time ranges and thresholds."""
    keyed = with_key(current)
    counts = keyed.agg(
        F.countDistinct(*KEY).alias("current_outcome_count"),
        F.countDistinct(*[F.when(_has_identity(), F.col(c)) for c in KEY[:2]]).alias("current_market_count"),
    )
    times = time_range(current).select(
        F.col("earliest").alias("current_earliest"), F.col("latest").alias("current_latest")
    )
    pieces = [counts, times]
    if previous is not None:
        pieces.append(new_markets(current, previous).agg(F.count(F.lit(1)).alias("new_market_count")))
        pieces.append(
            time_range(previous).select(
                F.col("earliest").alias("previous_earliest"), F.col("latest").alias("previous_latest")
            )
        )
    parts = _one_row(pieces)
    for name, kind in (("new_market_count", "bigint"), ("previous_earliest", "string"), ("previous_latest", "string")):
        if previous is None:
            parts = parts.withColumn(name, F.lit(None).cast(kind))
    return parts.select(
        F.lit(previous is not None).alias("comparison_requested"),
        "current_outcome_count",
        "current_market_count",
        "new_market_count",
        "current_earliest",
        "current_latest",
        "previous_earliest",
        "previous_latest",
        *_thresholds(minimum_move_pp, wide_spread, thin_volume or THIN_VOLUME),
    )


def _thresholds(minimum_move_pp: float, wide_spread: float, limits: Mapping[str, float]) -> list[Column]:
    venues = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])
    return [
        F.lit(float(minimum_move_pp)).alias("minimum_move_pp"), F.lit(float(wide_spread)).alias("wide_spread"),
        venues.alias("thin_cumulative_volume_by_venue"),
    ]


def both_sides(current: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Every identity of either snapshot with its latest row on each side, ``prev_`` columns the previous one.

    Each snapshot is read once and reduced once; beside the latest row the reduction keeps the number of
    copies and the first and last instant, so all reports follow from this table.
    """
    at = instant(F.col("observed_at"))
    span = {"earliest": F.min(at), "latest": F.max(at)}
    cur = _latest(current, _CURRENT_FIELDS, span)
    before = list(dict.fromkeys([*IDENTITY, *_PREVIOUS_FIELDS]))
    if previous is None:
        nothing = {f"prev_{c}": F.lit(None).cast(_OPTIONAL.get(c, "string")) for c in before}
        stamps = {f"prev_{c}": F.lit(None).cast("timestamp") for c in span}
        return cur.withColumns({**nothing, **stamps, "prev_copies": F.lit(None).cast("bigint")})
    prev = _latest(previous, before, span)
    return cur.join(prev.select(*KEY, *[F.col(c).alias(f"prev_{c}") for c in [*before, "copies", *span]]), KEY, "full_outer")


def _summary_of(sides: DataFrame, requested: bool, minimum_move_pp: float, wide_spread: float, limits: Mapping[str, float]) -> DataFrame:
    here, there = F.col("copies").isNotNull(), F.col("prev_copies").isNotNull()
    markets = sides.groupBy(*KEY[:2]).agg(
        F.count_if(here).alias("outcomes"), F.bool_or(here & _has_identity()).alias("here"), F.bool_or(there).alias("there"),
        *[f(c).alias(c) for c, f in (("earliest", F.min), ("latest", F.max), ("prev_earliest", F.min), ("prev_latest", F.max))],
    )
    new = F.count_if(F.col("here") & ~F.col("there"))
    row = markets.agg(
        F.coalesce(F.sum("outcomes"), F.lit(0)).alias("current_outcome_count"), F.count_if("here").alias("current_market_count"),
        (new if requested else F.lit(None).cast("bigint")).alias("new_market_count"),
        _instant_text(F.min("earliest")).alias("current_earliest"), _instant_text(F.max("latest")).alias("current_latest"),
        _instant_text(F.min("prev_earliest")).alias("previous_earliest"), _instant_text(F.max("prev_latest")).alias("previous_latest"),
    )
    return row.select(F.lit(requested).alias("comparison_requested"), "*", *_thresholds(minimum_move_pp, wide_spread, limits))


def marked_sides(rows: DataFrame, current: str, part: str) -> DataFrame:
    """As :func:`both_sides`, from one table of both snapshots in which the boolean column ``current`` tells them apart.

    All rows of a market share a value of the column ``part``. Where the rows already lie together by it, as after
    a join on it, they are reduced where they lie: nothing is shuffled again, and no join of the sides is needed. Only rows
    without identity, which many parts may hold, are brought together by a second reduction.
    """
    fields = {"": [c for c in _CURRENT_FIELDS if c != "row_pos"], "prev_": list(dict.fromkeys([*IDENTITY, *_PREVIOUS_FIELDS]))}
    filled = with_key(_filled(rows.filter(F.col(current).isNotNull()), fields[""]))
    # Each row is carried once; which side it counts for is decided in the reduction.
    single = filled.select(
        part, *KEY, *fields[""], "row_pos", F.col(current).alias("__now"), instant(F.col("observed_at")).alias("__at")
    )
    of = {"": F.col("__now"), "prev_": ~F.col("__now")}
    first, again = [], []
    for p, mine in of.items():
        pos, at = F.when(mine, F.col("row_pos")), F.when(mine, F.col("__at"))
        row, copies = F.struct(*fields[p]), F.when(mine, F.lit(1))
        for name, of_rows, of_parts in (
            ("row", F.max_by(row, pos), F.max_by(f"{p}row", f"{p}last")), ("last", F.max(pos), F.max(f"{p}last")),
            ("first_pos", F.min(pos), F.min(f"{p}first_pos")), ("copies", F.sum(copies), F.sum(f"{p}copies")),
            ("earliest", F.min(at), F.min(f"{p}earliest")), ("latest", F.max(at), F.max(f"{p}latest")),
        ):
            first.append(of_rows.alias(f"{p}{name}"))
            again.append(of_parts.alias(f"{p}{name}"))
    reduced = single.groupBy(part, *KEY).agg(*first)
    loose = reduced.filter(~_has_identity()).groupBy(*KEY).agg(*again)
    sides = reduced.filter(_has_identity()).drop(part).unionByName(loose)
    return sides.select(
        *KEY,
        *[F.col(f"{p}row")[c].alias(f"{p}{c}") for p in of for c in fields[p]],
        *[f"{p}{c}" for p in of for c in ("copies", "earliest", "latest")],
        "first_pos",
    )


def analyze(
    current: DataFrame,
    previous: DataFrame | None = None,
    *,
    minimum_move_pp: float = MINIMUM_MOVE_PP,
    wide_spread: float = WIDE_SPREAD,
    thin_volume: Mapping[str, float] | None = None,
    compared_path: str | None = None,
) -> dict[str, DataFrame]:
    """All report tables, from one comparison of both sides.

    The comparison of :func:`both_sides` is judged and written once, to ``compared_path`` or below the shared folder,
    and every report reads it back; each snapshot is scanned once however many reports are used.
    """
    return _reports(both_sides(current, previous), previous is not None, minimum_move_pp, wide_spread, thin_volume, compared_path, True)


def analyze_marked(
    rows: DataFrame,
    current: str,
    part: str,
    *,
    minimum_move_pp: float = MINIMUM_MOVE_PP,
    wide_spread: float = WIDE_SPREAD,
    thin_volume: Mapping[str, float] | None = None,
    compared_path: str | None = None,
    ordered: bool = True,
) -> dict[str, DataFrame]:
    """As :func:`analyze`, from one table of both snapshots; see :func:`marked_sides`.

    With ``ordered`` off the reports are not sorted, which spares a shuffle of each where its rows are only stored on.
    """
    return _reports(marked_sides(rows, current, part), True, minimum_move_pp, wide_spread, thin_volume, compared_path, ordered)


def _reports(
    sides: DataFrame,
    requested: bool,
    minimum_move_pp: float,
    wide_spread: float,
    thin_volume: Mapping[str, float] | None,
    compared_path: str | None,
    ordered: bool,
) -> dict[str, DataFrame]:
    # The identity is that of the side there is; of the previous row only what a report shows is written.
    gone = F.col("copies").isNull()
    shown = sides.withColumns({c: F.when(gone, F.col(f"prev_{c}")).otherwise(F.col(c)) for c in IDENTITY})
    more = [F.col(c) for c in ("prev_copies", "earliest", "latest", "prev_earliest", "prev_latest")]
    # The prices of a row that is gone are null, so nothing of it is judged but what the filters below leave out.
    judged = _judged(shown, wide_spread, thin_volume, more)
    table = stored(judged if ordered else judged.drop("first_pos"), compared_path, tidy=True)
    compared = table.filter(F.col("copies").isNotNull())
    fresh = compared.filter(F.col("prev_copies").isNull() & F.lit(requested))
    return {
        "summary": _summary_of(table, requested, minimum_move_pp, wide_spread, thin_volume or THIN_VOLUME),
        "changes": changes(compared, ordered=ordered),
        "skipped_comparisons": skipped_comparisons(compared),
        "watchlist": watchlist(compared, minimum_move_pp=minimum_move_pp, comparison_requested=requested, ordered=ordered),
        "topic_market_counts": _topic_counts(compared, ordered),
        "new_coverage": _sorted(fresh, ordered, *KEY).select(*IDENTITY),
        "disappeared_coverage": _sorted(table.filter(F.col("copies").isNull()), ordered, *KEY).select(*IDENTITY),
        "interpretation": sides.sparkSession.createDataFrame(list(enumerate(INTERPRETATION)), "pos INT, caveat STRING"),
    }


def attach_manifests(compared_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """Compared snapshots with the manifest of the run each came from, when it is known."""
    return compared_runs.join(runs, "run_id", "left")
