"""Time-window planning: half-open chunks, candle windows, request budgets, saturation splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddslake.functions import computed

WEEK = 7 * 86400
CANDLE_PERIODS = [1, 60, 1440]
MAX_BATCH_CANDLES = 10_000
CANDLES_PER_REQUEST = 4_000


def default_range(start: Column, end: Column, run_epoch: Column) -> tuple[Column, Column]:
    """End defaults to the run time, start to one week before the end; an empty range stops the job."""
    stop = F.coalesce(end, run_epoch)
    begin = F.coalesce(start, stop - F.lit(WEEK))
    checked = F.when(stop > begin, begin).otherwise(F.raise_error(F.lit("end must be after start")).cast("bigint"))
    return checked, stop


def time_windows(ranges: DataFrame, step: int, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Cut [start, end) into half-open chunks of ``step`` seconds, the last one clipped."""
    if step <= 0:
        raise ValueError("step must be positive")
    lo, hi = F.col(start), F.col(end)
    refuse = F.raise_error(F.lit("end must be after start")).cast("array<bigint>")
    starts = F.when(hi > lo, F.sequence(lo, hi - 1, F.lit(step).cast("bigint"))).otherwise(refuse)
    return ranges.select("*", F.posexplode(starts).alias("window_index", "window_start")).withColumn(
        "window_end", F.least(F.col("window_start") + step, hi)
    )


def candle_windows(
    ranges: DataFrame,
    period_minutes: int,
    bars_per_window: int = 1000,
    max_windows: int | None = None,
    start: str = "start_ts",
    end: str = "end_ts",
) -> DataFrame:
    """Inclusive, non-overlapping windows of at most ``bars_per_window`` bars.

    With ``max_windows`` a range gets no more windows, and ``truncated`` marks those whose end was
    not reached; without, every range is planned to its end.
    """
    if period_minutes not in CANDLE_PERIODS:
        raise ValueError(f"period must be one of {CANDLE_PERIODS} minutes")
    if (max_windows is not None and max_windows < 1) or not 1 <= bars_per_window <= 1000:
        raise ValueError("max_windows >= 1 and bars_per_window between 1 and 1000 required")
    span = period_minutes * 60 * bars_per_window
    lo, hi = F.col(start), F.col(end)
    reach = hi if max_windows is None else lo + F.lit(span * max_windows - 1)
    refuse = F.raise_error(F.lit("expected nonnegative seconds with start <= end")).cast("array<bigint>")
    starts = F.when(
        (lo >= 0) & (hi >= lo), F.sequence(lo, F.least(hi, reach), F.lit(span).cast("bigint"))
    ).otherwise(refuse)
    return (
        ranges.withColumn("truncated", hi > reach)
        .select("*", F.posexplode(starts).alias("window_index", "window_start"))
        .withColumn("window_end", F.least(F.col("window_start") + F.lit(span - 1), hi))
    )


def candle_budget(batches: DataFrame, period_minutes: int, n_tickers: str = "n_tickers") -> DataFrame:
    """Upper estimate of candles a batch request returns, and whether it fits the limit."""
    if period_minutes not in CANDLE_PERIODS:
        raise ValueError(f"period must be one of {CANDLE_PERIODS} minutes")
    per_ticker = F.floor((F.col("end_ts") - F.col("start_ts")) / F.lit(period_minutes * 60)) + 2
    return batches.withColumn("candle_estimate", per_ticker * F.col(n_tickers)).withColumn(
        "fits", F.col("candle_estimate") <= MAX_BATCH_CANDLES
    )


def _path(second: Column, start: int, end: int, levels: int) -> Column:
    """The halves that hold a second, one bit a level from the top, and the level at which it is alone.

    Levels below that one add zeros.
    """
    state = F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in (("lo", start), ("hi", end), ("bits", 0), ("depth", 0))])

    def descend(w: Column, _: Column) -> Column:
        mid = F.shiftright(w["lo"] + w["hi"], 1)
        splits, right = w["lo"] < w["hi"], (w["lo"] < w["hi"]) & (second > mid)
        return F.struct(
            F.when(right, mid + 1).otherwise(w["lo"]).alias("lo"), F.when(splits & ~right, mid).otherwise(w["hi"]).alias("hi"),
            (F.shiftleft(w["bits"], 1) + right.cast("bigint")).alias("bits"), (w["depth"] + splits.cast("bigint")).alias("depth"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), state, descend)


def _window(path: Column, depth: Column, start: int, end: int) -> Column:
    """First and last second of the window that the ``depth`` bits of ``path`` lead to."""
    state = F.struct(F.lit(start).cast("bigint").alias("lo"), F.lit(end).cast("bigint").alias("hi"))

    def descend(w: Column, level: Column) -> Column:
        mid = F.shiftright(w["lo"] + w["hi"], 1)
        right = F.call_function("getbit", path, (depth - level).cast("int")) == 1
        return F.struct(F.when(right, mid + 1).otherwise(w["lo"]).alias("lo"), F.when(right, w["hi"]).otherwise(mid).alias("hi"))

    levels = F.when(depth > 0, F.sequence(F.lit(1).cast("bigint"), depth.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(levels, state, descend)


def _deepest_full(rows: DataFrame, keys: Sequence[str], bits: str, n: str, levels: int, capacity: int, out: str) -> DataFrame:
    """Add ``out``: the level of the smallest window that holds a row and at least ``capacity``, null if none does.

    In the order of ``bits``, such a window holds a run of neighbours that include the row, add up to the capacity, and
    need both their ends for it; the window is what the paths of the two ends share. Runs that end at the row, and
    runs that begin at it or before, are the candidates.
    """
    keys = list(keys)
    key = W.partitionBy(*keys)
    counted = rows.withColumn("__upto", F.sum(n).over(key.orderBy(bits).rowsBetween(W.unboundedPreceding, W.currentRow)))
    counted = counted.withColumn("__before", F.col("__upto") - F.col(n))
    by_before, by_upto = key.orderBy("__before"), key.orderBy("__upto")

    def shared(other: Column) -> Column:
        apart = F.col(bits).bitwiseXOR(other)
        return F.when(apart == 0, F.lit(levels)).otherwise(F.lit(levels) - F.length(F.bin(apart)))

    onward = by_before.rangeBetween(0, capacity - 1)
    begun = counted.withColumn(
        "__run", F.when(F.max("__upto").over(onward) - F.col("__before") >= capacity, shared(F.last(bits).over(onward)))
    ).withColumn("__held", F.max("__run").over(by_before.rangeBetween(1 - capacity, 0)))
    first = F.first(bits).over(by_upto.rangeBetween(1 - capacity, 0))
    ended = F.when(F.col("__upto") >= capacity, shared(first))
    return begun.withColumn(out, F.greatest("__held", ended)).drop("__upto", "__before", "__run", "__held")


def split_saturated(
    rows: DataFrame, keys: Sequence[str], second: str, start: int, end: int, page_size: int, max_offset: int, max_requests: int = 200
) -> DataFrame:
    """Windows a bisecting reader ends up with so that every one fits the offset budget.

    Inclusive windows of [start, end] are halved while they hold too many rows for the pages reachable
    under ``max_offset``. Windows are disjoint and cover the range, empty ones included, for every key
    with a row in it; ``over_budget`` marks a single second that cannot be split further. ``requests``
    counts the pages read of a window; ``incomplete`` marks keys that need more than ``max_requests`` in
    total, the pages of windows given up for their halves included.

    Rows are counted by second. The upper half of the levels is a bucket: within a bucket, and
    among the buckets of a key, neighbours in time tell the smallest window with too many rows, so
    no second is counted once a level and no task holds more than a bucket of seconds or a key's buckets.
    """
    capacity = (max_offset // page_size + 1) * page_size
    levels = max(1, (end - start).bit_length())
    upper = levels - levels // 2
    keys = list(keys)
    counted = rows.filter(F.col(second).between(start, end)).groupBy(*keys, F.col(second).cast("bigint").alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    placed = computed(counted, __path=_path(F.col("__t"), start, end, levels))
    seconds = placed.select(
        *keys, "__n", F.col("__path.bits").alias("__bits"), F.col("__path.depth").alias("__alone"), F.shiftright("__path.bits", levels - upper).alias("__bucket")
    )
    buckets = seconds.groupBy(*keys, "__bucket").agg(F.sum("__n").alias("__n"))
    coarse = _deepest_full(buckets, keys, "__bucket", "__n", upper, capacity, "__coarse").drop("__n")
    fine = _deepest_full(seconds, [*keys, "__bucket"], "__bits", "__n", levels, capacity, "__fine")
    full = F.coalesce("__fine", "__coarse")
    depth = F.least(F.coalesce(full + 1, F.lit(0)), F.col("__alone")).cast("int")
    leaves = (
        fine.join(coarse, [*keys, "__bucket"]).select(*keys, "__n", "__bits", depth.alias("__depth"))
        .groupBy(*keys, "__depth", F.expr(f"shiftright(__bits, {levels} - __depth)").alias("__way")).agg(F.sum("__n").alias("n_rows"))
    )
    # A window that was split holds rows in a half that leads to a leaf; its other half leads to one too or is empty.
    way, at = F.col("__way"), F.col("__depth")
    node = lambda level, way, n, leaf, held: F.struct(level.alias("depth"), way.alias("way"), n.alias("n"), leaf.alias("leaf"), held.alias("held"))
    none, yes, no = F.lit(0).cast("bigint"), F.lit(True), F.lit(False)
    halves = F.transform(
        F.when(at > 0, F.sequence(F.lit(1), at)).otherwise(F.array().cast("array<int>")),
        lambda level: F.array(
            node(level, F.call_function("shiftright", way, at - level), none, no, yes),
            node(level, F.call_function("shiftright", way, at - level).bitwiseXOR(F.lit(1)), none, no, no),
        ),
    )
    itself = F.array(node(at, way, F.col("n_rows"), yes, yes))
    visited = (
        leaves.select(*keys, F.explode(F.concat(itself, F.flatten(halves))).alias("w")).groupBy(*keys, "w.depth", "w.way")
        .agg(F.sum("w.n").alias("n_rows"), F.bool_or("w.leaf").alias("__leaf"), F.bool_or("w.held").alias("__held"))
        .filter(F.col("__leaf") | ~F.col("__held"))
    )
    pages = capacity // page_size
    requests = F.when(F.col("n_rows") >= capacity, F.lit(pages).cast("bigint")).otherwise(F.floor(F.col("n_rows") / page_size) + 1)
    read = visited.withColumn("requests", requests)
    # Halving once gives one window more, so as many were given up as there are final ones less one, each at its full pages.
    totals = read.groupBy(*keys).agg((F.sum("requests") + (F.count(F.lit(1)) - 1) * pages).alias("__total"))
    return computed(read.join(totals, keys), __w=_window(F.col("way"), F.col("depth"), start, end)).select(
        *keys, F.col("__w.lo").alias("window_start"), F.col("__w.hi").alias("window_end"), "n_rows", "requests",
        (F.col("n_rows") >= capacity).alias("over_budget"), (F.col("__total") > max_requests).alias("incomplete"),
    )
