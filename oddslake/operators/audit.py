"""Audits over the landed request log: retries, pagination, run status, value ranges.

Everything is an aggregate with a partial stage, so one very chatty run or endpoint is reduced
where its rows are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.functions import fingerprint

# Statuses worth another attempt, and the cursor that marks the last page.
RETRYABLE = [408, 429, 500, 502, 503, 504]
LAST_CURSOR = "LTE="


def retry_audit(raw: DataFrame, keys: Sequence[str] = ("run_id", "method", "url", "params", "request_body")) -> DataFrame:
    """Attempts, retryable responses and the terminal outcome of each distinct request.

    A map cannot be a grouping key, so ``params`` is keyed by its sorted entries.
    """
    request = raw
    grouping = []
    for key in keys:
        if dict(raw.dtypes)[key].startswith("map"):
            request = request.withColumn(key, F.to_json(F.array_sort(F.map_entries(key))))
        grouping.append(key)
    last = F.max_by("status_code", "row_pos")
    audited = request.groupBy(*grouping).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("attempt") == 1).alias("calls"),
        F.count_if(F.col("status_code").isin(*RETRYABLE)).alias("retryable_responses"),
        F.count_if(F.col("error").isNotNull()).alias("transport_failures"),
        last.alias("last_status"),
        F.max_by("error", "row_pos").alias("last_error"),
    )
    outcome = (
        F.when(F.col("last_error").isNotNull(), F.lit("transport_failure"))
        .when(F.col("last_status").between(200, 299), F.lit("success"))
        .when(F.col("last_status").isin(*RETRYABLE), F.lit("retries_exhausted"))
        .otherwise(F.lit("terminal_error"))
    )
    return audited.withColumn("outcome", outcome)


def _repeated(rows: DataFrame, walk: list[str], value: str, out: str) -> DataFrame:
    """Per walk, the number of distinct values that occur more than once."""
    counted = rows.groupBy(*walk, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*walk).agg(F.count_if(F.col("n") > 1).alias(out))


def pagination_audit(
    pages: DataFrame, walk: Sequence[str] = ("run_id", "endpoint", "filters"), max_pages: int | None = None
) -> DataFrame:
    """State of each page walk, from one row per page.

    Input has the walk keys, ``row_pos``, the request ``cursor``, the response ``next_cursor``
    and ``rows_json`` (the page's row array). Repeats are found by counting equal cursors and
    equal page fingerprints, never by listing a walk's pages in one task.
    """
    walk = list(walk)
    is_end = F.coalesce("next_cursor", F.lit("")).isin("", LAST_CURSOR)
    facts = pages.select(
        *walk,
        "row_pos",
        F.when(~is_end, F.col("next_cursor")).alias("next_cursor"),
        F.coalesce("cursor", F.lit("")).alias("cursor"),
        F.coalesce("rows_json", F.lit("[]")).isin("", "[]").alias("empty"),
        F.col("rows_json"),
    )
    ends = facts.groupBy(*walk).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("empty").alias("empty_pages"),
        F.max_by(F.coalesce("next_cursor", F.lit("")), "row_pos").alias("last_cursor"),
        F.min_by("cursor", "row_pos").alias("first_cursor"),
    )
    # A cursor counts as seen when the walk started from it or an earlier page offered it.
    starts = ends.filter(F.col("first_cursor") != "").select(*walk, F.col("first_cursor").alias("next_cursor"))
    offered = facts.filter(F.col("next_cursor").isNotNull()).select(*walk, "next_cursor").unionByName(starts)
    cursors = _repeated(offered, walk, "next_cursor", "repeated_cursors")
    # Only this branch reads and hashes the row arrays.
    prints = facts.filter(~F.col("empty")).select(*walk, fingerprint(F.col("rows_json")).alias("page"))
    repeats = _repeated(prints, walk, "page", "repeated_pages")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = (
        ends.join(cursors, walk, "left")
        .join(repeats, walk, "left")
        .select(*ends.columns, zero("repeated_cursors"), zero("repeated_pages"))
    )
    capped = F.col("pages") >= max_pages if max_pages else F.lit(True)
    status = (
        F.when(F.col("repeated_pages") > 0, F.lit("repeated_page"))
        .when(F.col("repeated_cursors") > 0, F.lit("repeated_cursor"))
        .when((F.col("last_cursor") != "") & capped, F.lit("incomplete_cursor_remains"))
        .when(F.col("last_cursor") != "", F.lit("stopped_early"))
        .otherwise(F.lit("complete"))
    )
    return joined.select(*walk, "pages", "empty_pages", "repeated_pages", "repeated_cursors", status.alias("status"))


def run_status(raw: DataFrame, errors: DataFrame, warnings: DataFrame, runs: DataFrame) -> DataFrame:
    """Request, error and warning counts per run and the resulting manifest status.

    ``runs`` has run_id, finished (false while running) and fatal.
    """
    count = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = (
        runs.join(count(raw, "request_count"), "run_id", "left")
        .join(count(errors, "error_count"), "run_id", "left")
        .join(count(warnings.distinct(), "warning_count"), "run_id", "left")
        .select(*runs.columns, zero("request_count"), zero("error_count"), zero("warning_count"))
    )
    status = (
        F.when(~F.col("finished"), F.lit("running"))
        .when(F.col("fatal"), F.lit("failed"))
        .when((F.col("error_count") > 0) | (F.col("warning_count") > 0), F.lit("partial"))
        .otherwise(F.lit("complete_within_requested_scope"))
    )
    code = F.when(F.col("fatal") | (F.col("error_count") > 0), 2).otherwise(0)
    return joined.withColumn("status", status).withColumn("exit_code", code)


def run_manifests(runs: DataFrame, raw: DataFrame, errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """The manifest of each run: its settings and times, counts, status, and what went wrong.

    ``runs`` has run_id, started_at, finished_at (null while running), settings and fatal; ``errors``
    run_id, operation and error; ``warnings`` run_id and warning. Equal errors are listed once with
    how often they came, so a list is as long as there are kinds of them.
    """
    status = run_status(raw, errors, warnings, runs.withColumn("finished", F.col("finished_at").isNotNull()))
    kinds = errors.groupBy("run_id", "operation", "error").agg(F.count(F.lit(1)).alias("times"))
    listed = kinds.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("operation", "error", "times"))).alias("errors"))
    said = warnings.select("run_id", "warning").distinct().groupBy("run_id").agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
    none = F.array().cast("array<struct<operation:string,error:string,times:bigint>>")
    return (
        status.join(listed, "run_id", "left")
        .join(said, "run_id", "left")
        .withColumns({"errors": F.coalesce("errors", none), "warnings": F.coalesce("warnings", F.array().cast("array<string>"))})
        .drop("finished")
    )


def check_ranges(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per rule; a rule is a condition that must hold, null does not violate it."""
    counts = rows.agg(*[F.count_if(~condition).alias(name) for name, condition in rules.items()])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    )
    return counts.select(pairs.alias("v")).select("v.rule", "v.violations")


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The offending rows themselves, one per row and broken rule."""
    broken = F.array_compact(F.array(*[F.when(~condition, F.lit(name)) for name, condition in rules.items()]))
    return rows.withColumn("rule", F.explode(broken))


def dataset_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("dataset"), "rows") for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
