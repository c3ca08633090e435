"""Stream frames derived from ``events``: parsing, gaps, segments, summaries, a streamed run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddslake import schemas
from oddslake.plans.registry import Query, json_text, quoted, table
from oddslake.session import shared_dir
from oddslake.streaming import frames as S


def _frame(events: DataFrame) -> DataFrame:
    """Capture per event type, connection per day, sequence per ``event_id % 8``; every 101st
    row is a gap record, every 53rd a heartbeat, every 47th a list, every 211th an error."""
    e = F.col("event_id")
    kind = F.when(e % 101 == 0, "gap").when(e % 103 == 0, "connected").otherwise("message")
    book = json_text(type=quoted(F.when(e % 2 == 0, "orderbook_delta").otherwise("orderbook_snapshot")), sid=(e % 8).cast("string"), seq=F.floor(e / 8).cast("string"))
    data = (
        F.when(kind != "message", F.lit(None).cast("string"))
        .when(e % 53 == 0, "PONG")
        .when(e % 47 == 0, F.concat(F.lit('[{"event_type":"book"},{"topic":"comments","payload":{"a":1}},{"event_type":"ack"},'), e.cast("string"), F.lit("]")))
        .when(e % 211 == 0, F.lit('{"type":"error"}'))
        .when(e % 43 == 0, F.concat(F.lit("plain "), e.cast("string")))
        .when(e % 5 == 0, F.lit('{"type":"subscribed"}'))
        .otherwise(book)
    )
    return events.select(
        F.col("event_type").alias("run_id"), e.alias("row_pos"), F.dayofmonth("ts").alias("connection_id"), kind.alias("kind"), data.alias("data"), "value",
        F.col("ts").alias("observed_at"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(table(spark, sf_dir, "events"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse_frames(S.drop_heartbeats(frames(spark, sf_dir)))


def parsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("row_pos", "kind", "message_type", "sid", "seq", "data_items", "is_error", F.get_json_object("data", "$.text").alias("plain_text"))


def _numbered(rows: DataFrame) -> DataFrame:
    """All frames as one of eight order books each, whose numbering skips one in every fifty."""
    book = F.floor(F.col("row_pos") / 8)
    return rows.select(
        F.lit("capture").alias("run_id"), "connection_id", (F.col("row_pos") % 8).cast("string").alias("sid"), (book + F.floor(book / 50)).alias("seq"), "row_pos", "observed_at"
    )


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sequence_gaps(_numbered(frames(spark, sf_dir)))


def gaps_small_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same gaps when every subscription is cut into many buckets."""
    return S.sequence_gaps(_numbered(frames(spark, sf_dir)), width=97)


#: Landed files of the streamed queries, and how many of them a trigger takes.
LANDED_FILES, FILES_A_TRIGGER = 6, 2


def _landed(rows: DataFrame) -> str:
    """Frames as JSON lines, in files that arrive one after another in the order of positions; returns their folder."""
    root = f"{shared_dir(rows.sparkSession)}/frames-{uuid.uuid4().hex}"
    ends = rows.agg(F.min("row_pos"), F.max("row_pos")).first()
    first, last = (ends[0] or 0), (ends[1] or 0)
    step = (last - first) // LANDED_FILES + 1
    shaped = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schemas.FRAME).fields])
    for part in range(LANDED_FILES):
        low = first + part * step
        shaped.where((F.col("row_pos") >= low) & (F.col("row_pos") < low + step)).write.mode("append").json(f"{root}/in")
    return root


def streamed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same gaps from a stream of landed frames, several micro-batches long."""
    book = _numbered(frames(spark, sf_dir))
    data = json_text(type=quoted(F.lit("orderbook_delta")), sid=F.col("sid"), seq=F.col("seq").cast("string"))
    root = _landed(book.withColumn("kind", F.lit("message")).withColumn("data", data))
    arriving = S.read_frames(spark, f"{root}/in", streaming=True, max_files=FILES_A_TRIGGER)
    return S.run_sequence_gaps(S.sequenced(S.parse_frames(arriving)), f"{root}/out", f"{root}/checkpoint")


def streamed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries of all captures from a stream of landed frames."""
    root = _landed(frames(spark, sf_dir))
    arriving = S.drop_heartbeats(S.read_frames(spark, f"{root}/in", streaming=True, max_files=FILES_A_TRIGGER))
    # Events are numbered in the order of their time.
    S.summary_stream(S.parse_frames(arriving), f"{root}/out", f"{root}/checkpoint", span="1 day", lateness="1 day").awaitTermination()
    return _shown(S.read_summary(spark, f"{root}/out"))


def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.segments(frames(spark, sf_dir), width=1000)
    return rows.select("run_id", "row_pos", "segment")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.stream_summary(parsed(spark, sf_dir)))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("run_id", "messages", "data_messages", "connections", "gaps", "server_errors", F.array_join("warnings", "|").alias("warnings"), "status")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.data_items(S.drop_heartbeats(frames(spark, sf_dir)))
    return rows.groupBy("run_id", "item_pos").agg(F.count(F.lit(1)).alias("items"), F.count_if("is_data").alias("data_items"))


FRAMES = """
f AS (SELECT event_id AS e, event_type AS run_id, day(ts) AS connection_id, CASE WHEN event_id % 101 = 0 THEN 'gap' WHEN event_id % 103 = 0 THEN 'connected' ELSE 'message' END AS kind, value FROM events),
t AS (SELECT *, CASE WHEN kind <> 'message' THEN 'none' WHEN e % 53 = 0 THEN 'pong' WHEN e % 47 = 0 THEN 'list' WHEN e % 211 = 0 THEN 'error' WHEN e % 43 = 0 THEN 'plain' WHEN e % 5 = 0 THEN 'ack' ELSE 'book' END AS what FROM f),
p AS (SELECT *, CASE what WHEN 'list' THEN 2 WHEN 'book' THEN 1 ELSE 0 END AS data_items FROM t WHERE what <> 'pong')"""
GAPS = """WITH q AS (SELECT day(ts) AS connection_id, event_id, event_id // 8 + event_id // 8 // 50 AS seq, CAST(event_id % 8 AS VARCHAR) AS sid FROM events),
n AS (SELECT *, lag(seq) OVER (PARTITION BY connection_id, sid ORDER BY event_id) AS prev FROM q)
SELECT 'capture' AS run_id, connection_id, sid, event_id AS row_pos, prev + 1 AS expected_seq, seq AS got_seq FROM n WHERE seq <> prev + 1"""
SUMMARY = (
    "WITH" + FRAMES + """, g AS (SELECT run_id, count(*) FILTER (kind = 'message') AS messages, CAST(sum(data_items) AS BIGINT) AS data_messages, max(connection_id) + 1 AS connections,
          count(*) FILTER (kind = 'gap') AS gaps, count(*) FILTER (what = 'error') AS server_errors FROM p GROUP BY 1)
        SELECT *, concat_ws('|', CASE WHEN gaps > 0 THEN CAST(gaps AS VARCHAR) || ' connection/sequence gaps; do not reconstruct across gaps' END,
          CASE WHEN data_messages = 0 THEN 'No data messages captured; subscription success/market activity is unverified' END) AS warnings,
          CASE WHEN server_errors > 0 THEN 'failed' WHEN gaps > 0 OR data_messages = 0 THEN 'partial' ELSE 'complete_within_requested_scope' END AS status FROM g"""
)

QUERIES = [
    Query(
        "frames_parsed",
        parsed_rows,
        "WITH" + FRAMES + """ SELECT e AS row_pos, kind, CASE what WHEN 'error' THEN 'error' WHEN 'ack' THEN 'subscribed' WHEN 'book' THEN CASE WHEN e % 2 = 0 THEN 'orderbook_delta' ELSE 'orderbook_snapshot' END END AS message_type,
          CASE WHEN what = 'book' THEN CAST(e % 8 AS VARCHAR) END AS sid, CASE WHEN what = 'book' THEN e // 8 END AS seq, data_items, what = 'error' AS is_error,
          CASE WHEN what = 'plain' THEN 'plain ' || CAST(e AS VARCHAR) END AS plain_text FROM p""",
    ),
    Query("sequence_gaps", gaps, GAPS),
    Query("sequence_gaps_bucketed", gaps_small_buckets, GAPS),
    Query("sequence_gaps_streamed", streamed_gaps, GAPS),
    Query(
        "frame_segments",
        segment_rows,
        "WITH" + FRAMES + " SELECT run_id, e AS row_pos, CAST(sum(CAST(kind = 'gap' AS INT)) OVER (PARTITION BY run_id ORDER BY e) AS BIGINT) AS segment FROM f",
    ),
    Query("stream_summary", summaries, SUMMARY),
    Query("stream_summary_streamed", streamed_summaries, SUMMARY),
    Query(
        "frame_items",
        items,
        "WITH" + FRAMES + """, x AS (SELECT run_id, what, unnest(CASE WHEN what = 'list' THEN [0, 1, 2, 3] ELSE [0] END) AS item_pos FROM p WHERE kind = 'message')
        SELECT run_id, item_pos, count(*) AS items, count(*) FILTER (what = 'book' OR (what = 'list' AND item_pos < 2)) AS data_items FROM x GROUP BY ALL""",
    ),
]
