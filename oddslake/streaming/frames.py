"""Landed stream frames: parsing, data-message counts, connection segments, sequence gaps.

The batch operators below work on any finite frame table. The streaming form of gap detection uses them
inside each micro-batch; only one border row per subscription and micro-batch meets the engine's state store,
which holds the last sequence number of each subscription until it expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from oddslake import schemas
from oddslake.functions import computed, lag_ordered, latest_by, running_sum
from oddslake.functions.ordered import BUCKET_WIDTH

# Heartbeat frames, message types that carry data, types with sequence numbers.
HEARTBEATS = ["PING", "ping", "PONG", "pong", ""]
DATA_TYPES = [
    "book", "price_change", "last_trade_price", "tick_size_change", "best_bid_ask", "new_market",
    "market_resolved", "ticker", "trade", "orderbook_snapshot", "orderbook_delta", "fill",
    "market_lifecycle_v2", "market_positions",
]
SEQUENCED = ["orderbook_snapshot", "orderbook_delta"]
SUBSCRIPTION = ["run_id", "connection_id", "sid"]
GAP_WARNING = "%d connection/sequence gaps; do not reconstruct across gaps"
NO_DATA_WARNING = "No data messages captured; subscription success/market activity is unverified"
_MESSAGE = "type STRING, event_type STRING, topic STRING, payload STRING, sid STRING, seq BIGINT, error STRING"


def read_frames(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Landed frames as JSON lines, for a batch or as a stream of new files."""
    if not streaming:
        return spark.read.schema(schemas.FRAME).json(path)
    reader = spark.readStream.schema(schemas.FRAME)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def drop_heartbeats(frames: DataFrame, text: str = "data") -> DataFrame:
    """Remove keep-alive text; anything that is not JSON becomes ``{"text": …}``."""
    kept = frames.filter(~F.coalesce((F.col("kind") == "message") & F.col(text).isin(*HEARTBEATS), F.lit(False)))
    wrapped = F.to_json(F.struct(F.col(text).alias("text")))
    return kept.withColumn(
        text, F.when(F.col(text).isNull() | F.try_parse_json(text).isNotNull(), F.col(text)).otherwise(wrapped)
    )


def _filled(text: Column) -> Column:
    """Truthiness of a JSON value held as text."""
    return ~F.coalesce(text, F.lit("")).isin("", "false", "0", "0.0", "[]", "{}")


def is_data(item: Column) -> Column:
    known = F.coalesce(item["event_type"].isin(*DATA_TYPES), F.lit(False)) | F.coalesce(
        item["type"].isin(*DATA_TYPES), F.lit(False)
    )
    return known | (_filled(item["topic"]) & _filled(item["payload"]))


def parse_frames(frames: DataFrame, text: str = "data") -> DataFrame:
    """Add message fields, the number of data items in the frame and the server-error mark.

    A list frame counts each of its objects; sequence fields apply to single objects only.
    """
    items = F.when(
        F.col(text).rlike(r"^\s*\["),
        F.transform(
            F.filter(F.from_json(text, "array<string>"), lambda x: x.startswith("{")),
            lambda x: F.from_json(x, _MESSAGE),
        ),
    )
    single = F.when(F.col(text).rlike(r"^\s*\{"), F.from_json(text, _MESSAGE))
    message = computed(frames, __items=items, __one=single)
    one = F.col("__one")
    counted = F.when(F.col("__items").isNotNull(), F.size(F.filter("__items", is_data))).otherwise(
        F.when(one.isNotNull() & is_data(one), 1).otherwise(0)
    )
    sequenced = F.col("__one.type").isin(*SEQUENCED)
    return (
        message.withColumn("message_type", F.col("__one.type"))
        .withColumn("data_items", F.when(F.col("kind") == "message", counted).otherwise(0))
        .withColumn("sid", F.when(sequenced, F.col("__one.sid")))
        .withColumn("seq", F.when(sequenced, F.col("__one.seq")))
        .withColumn(
            "is_error",
            F.coalesce((F.col("kind") == "message") & ((F.col("__one.type") == "error") | _filled(F.col("__one.error"))), F.lit(False)),
        )
        .drop("__items", "__one")
    )


def data_items(frames: DataFrame, text: str = "data") -> DataFrame:
    """One row per object in the message frames, list frames exploded."""
    listed = F.when(F.col(text).rlike(r"^\s*\["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    keep = [c for c in frames.columns if c != text]
    return (
        frames.filter(F.col("kind") == "message")
        .select(*keep, F.posexplode(listed).alias("item_pos", "item"))
        .withColumn("is_data", F.coalesce(is_data(F.from_json("item", _MESSAGE)) & F.col("item").startswith("{"), F.lit(False)))
    )


def sequenced(parsed: DataFrame) -> DataFrame:
    """Frames that take part in continuity checks, with non-null subscription keys."""
    return parsed.filter(F.col("sid").isNotNull() & F.col("seq").isNotNull()).select(*SUBSCRIPTION, "row_pos", "seq", "observed_at")


def _gap_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("previous_seq").isNotNull() & (F.col("seq") != F.col("previous_seq") + 1)).select(
        *SUBSCRIPTION, "row_pos", (F.col("previous_seq") + 1).alias("expected_seq"), F.col("seq").alias("got_seq")
    )


def sequence_gaps(frames: DataFrame, width: int = BUCKET_WIDTH) -> DataFrame:
    """Breaks in the numbering of each (run, connection, subscription), in arrival order.

    ``frames`` has run_id, connection_id, sid, seq and row_pos. A new connection starts afresh
    because it is part of the key.
    """
    return _gap_rows(lag_ordered(frames, SUBSCRIPTION, "row_pos", "seq", "previous_seq", width))


def segments(frames: DataFrame, width: int = BUCKET_WIDTH) -> DataFrame:
    """Number the unbroken stretches of each capture: ``segment`` grows with every gap record.

    A book may be rebuilt only inside one (connection_id, segment).
    """
    return running_sum(frames, ["run_id"], "row_pos", (F.col("kind") == "gap").cast("int"), "segment", width)


def stream_summary(parsed: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Messages, data messages, connections, gaps and warnings per capture.

    Only plain aggregates, so the same call serves a batch and a streaming query in update mode.
    """
    return _judged(parsed.groupBy(*keys).agg(*_totals()))


def _totals() -> list[Column]:
    return [
        F.count_if(F.col("kind") == "message").alias("messages"),
        F.coalesce(F.sum("data_items"), F.lit(0)).alias("data_messages"),
        (F.coalesce(F.max("connection_id"), F.lit(-1)) + 1).alias("connections"),
        F.count_if(F.col("kind") == "gap").alias("gaps"),
        F.count_if("is_error").alias("server_errors"),
    ]


def _judged(totals: DataFrame) -> DataFrame:
    warnings = F.array_compact(
        F.array(
            F.when(F.col("gaps") > 0, F.format_string(GAP_WARNING, F.col("gaps"))),
            F.when(F.col("data_messages") == 0, F.lit(NO_DATA_WARNING)),
        )
    )
    status = F.when(F.col("server_errors") > 0, F.lit("failed")).when(F.size("warnings") > 0, F.lit("partial"))
    return totals.withColumn("warnings", warnings).withColumn(
        "status", F.coalesce(status, F.lit("complete_within_requested_scope"))
    )


GAP = "run_id STRING, connection_id INT, sid STRING, row_pos BIGINT, expected_seq BIGINT, got_seq BIGINT"
BORDER = "run_id STRING, connection_id INT, sid STRING, first_pos BIGINT, first_seq BIGINT, last_pos BIGINT, last_seq BIGINT, at TIMESTAMP"
#: A subscription is forgotten when frames this much younger than its last one have arrived.
FORGET_AFTER = "24 hours"
#: Files of borders that one trigger of the stateful query takes.
BORDER_FILES = 1_000


def borders(frames: DataFrame) -> DataFrame:
    """First and last frame of each subscription, and when its youngest arrived."""
    return frames.groupBy(*SUBSCRIPTION).agg(
        F.min("row_pos").alias("first_pos"), F.min_by("seq", "row_pos").alias("first_seq"),
        F.max("row_pos").alias("last_pos"), F.max_by("seq", "row_pos").alias("last_seq"),
        F.coalesce(F.max("at"), F.current_timestamp()).alias("at"),
    )


def inner_gaps_stream(frames: DataFrame, out_path: str, checkpoint_path: str, width: int = BUCKET_WIDTH, **trigger) -> StreamingQuery:
    """Write the gaps inside each micro-batch, and one border row per subscription and micro-batch.

    ``frames`` is :func:`sequenced` output. A micro-batch is a finite table, so :func:`sequence_gaps` finds its
    gaps in position buckets. Both results are folders named by the batch, replaced when a batch is repeated.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            sequence_gaps(batch, width).write.mode("overwrite").parquet(f"{out_path}/inner/batch={number}")
            borders(batch).write.mode("overwrite").parquet(f"{out_path}/borders/batch={number}")
        finally:
            batch.unpersist()

    keyed = frames.select("run_id", F.col("connection_id").cast("int").alias("connection_id"), "sid", "seq", "row_pos", F.col("observed_at").cast("timestamp").alias("at"))
    return keyed.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint_path}/inner").trigger(**(trigger or {"availableNow": True})).start()


def border_gaps(rows: DataFrame, forget_after: str = FORGET_AFTER) -> DataFrame:
    """Gaps between the micro-batches of a subscription, from a stream of border rows.

    The state of a subscription is the position and number of its last frame. Event time runs
    ``forget_after`` behind the youngest frame; a state whose frame it has passed is dropped by its timer, and rows
    behind it are late. A border whose frames all lie before the last known position was seen already.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        found, latest = [], None
        for chunk in chunks:  # a row for each micro-batch since the last trigger
            for row in chunk.sort_values("first_pos").itertuples():
                if last is not None and row.last_pos <= last[0]:
                    continue
                if last is not None and row.first_seq != last[1] + 1:
                    found.append((row.first_pos, last[1] + 1, row.first_seq))
                last, latest = (int(row.last_pos), int(row.last_seq)), row.at if latest is None else max(row.at, latest)
        if latest is not None:
            state.update(last)
            # At least a millisecond beyond event time, which the engine asks for.
            state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        positions, expected, got = zip(*found, strict=True) if found else ((), (), ())
        yield pd.DataFrame({
            "run_id": pd.Series([key[0]] * len(found), dtype="object"), "connection_id": pd.Series([key[1]] * len(found), dtype="int32"), "sid": pd.Series([key[2]] * len(found), dtype="object"),
            "row_pos": pd.Series(positions, dtype="int64"), "expected_seq": pd.Series(expected, dtype="int64"), "got_seq": pd.Series(got, dtype="int64"),
        })

    timed = rows.withWatermark("at", forget_after)
    return timed.groupBy(*SUBSCRIPTION).applyInPandasWithState(step, GAP, "pos BIGINT, seq BIGINT", "append", GroupStateTimeout.EventTimeTimeout)


def border_gaps_stream(spark: SparkSession, out_path: str, checkpoint_path: str, forget_after: str = FORGET_AFTER, max_files: int = BORDER_FILES, **trigger) -> StreamingQuery:
    """Run :func:`border_gaps` over the border rows that :func:`inner_gaps_stream` writes."""
    # Written as a pattern, so that batches which arrive later are found.
    rows = spark.readStream.schema(BORDER).option("maxFilesPerTrigger", max_files).parquet(f"{out_path}/borders/batch=*")
    return (
        border_gaps(rows, forget_after).writeStream.outputMode("append").format("parquet").option("path", f"{out_path}/between")
        .option("checkpointLocation", f"{checkpoint_path}/between").trigger(**(trigger or {"availableNow": True})).start()
    )


def run_sequence_gaps(frames: DataFrame, out_path: str, checkpoint_path: str, forget_after: str = FORGET_AFTER, width: int = BUCKET_WIDTH, max_files: int = BORDER_FILES) -> DataFrame:
    """:func:`sequence_gaps` over all that a stream of frames holds now, and its result so far.

    Run again on the same paths it goes on where it stopped. Both paths must be reachable by every
    executor; frames of a subscription must arrive in the order of their positions.
    """
    inner_gaps_stream(frames, out_path, checkpoint_path, width).awaitTermination()
    border_gaps_stream(frames.sparkSession, out_path, checkpoint_path, forget_after, max_files).awaitTermination()
    return read_gaps(frames.sparkSession, out_path)


def read_gaps(spark: SparkSession, out_path: str) -> DataFrame:
    """Gaps written by :func:`inner_gaps_stream` and :func:`border_gaps_stream`."""
    inside = spark.read.schema(GAP).parquet(f"{out_path}/inner/batch=*")
    return inside.unionByName(spark.read.schema(GAP).parquet(f"{out_path}/between"))


def summary_stream(parsed: DataFrame, out_path: str, checkpoint_path: str, span: str = "1 hour", lateness: str = "1 hour", **trigger) -> StreamingQuery:
    """Count a stream of :func:`parse_frames` output by capture and span of arrival.

    A span's counts leave the engine's state once frames ``lateness`` younger have arrived. Each micro-batch
    writes the spans that it changed to a folder of its own; :func:`read_summary` adds the newest of each up.
    """
    timed = parsed.withColumn("at", F.coalesce(F.col("observed_at").cast("timestamp"), F.lit(0).cast("timestamp"))).withWatermark("at", lateness)
    counts = timed.groupBy("run_id", F.window("at", span)["start"].alias("span")).agg(*_totals())

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_summary(spark: SparkSession, out_path: str) -> DataFrame:
    """:func:`stream_summary` of what :func:`summary_stream` has written so far."""
    written = spark.read.parquet(out_path)
    newest = latest_by(written, ["run_id", "span"], F.col("batch"))
    totals = newest.groupBy("run_id").agg(
        *[F.sum(c).alias(c) for c in ("messages", "data_messages", "gaps", "server_errors")], F.max("connections").alias("connections")
    )
    return _judged(totals).select("run_id", "messages", "data_messages", "connections", "gaps", "server_errors", "warnings", "status")
