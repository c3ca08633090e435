"""Queries that write a given table in a landed form and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.operators import audit, timewindows
from oddslake.plans.registry import Query, epoch, table, text
from oddslake.plans.stream_queries import frames
from oddslake.session import shared_dir
from oddslake.sources import tables
from oddslake.streaming import frames as S


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "jsonl")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 > 0, F.col("o_totalprice")).alias("price"), F.array(text("o_custkey"), "o_orderstatus").alias("tags"))
    tables.write_jsonl(rows, path)
    back = tables.read_jsonl(spark, path, "o_orderkey BIGINT, price DOUBLE, tags ARRAY<STRING>")
    return back.select("o_orderkey", "price", F.array_join("tags", ",").alias("tags"))


def csv_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _place(spark, "export")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("="), "c_mktsegment").alias("formula"), F.array("c_name").alias("names"))
    tables.export_tables({"customers": rows}, root, manifest=rows.agg(F.count(F.lit(1)).alias("rows")))
    back = spark.read.option("header", True).option("escape", '"').schema("c_custkey BIGINT, formula STRING, names STRING").csv(f"{root}/customers")
    manifest = tables.read_jsonl(spark, f"{root}/manifest", "rows BIGINT").select(F.col("rows").alias("c_custkey"), F.lit("manifest").alias("formula"), F.lit(None).cast("string").alias("names"))
    return back.unionByName(manifest)


def bronze_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table landed as JSON lines and taken into a partitioned table, each file once."""
    landing, bronze = _place(spark, "landing"), _place(spark, "bronze")
    tables.write_jsonl(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("run_id"), "value"), landing)
    for _ in range(2):  # the second run finds nothing new
        tables.ingest(spark, landing, "event_id BIGINT, run_id STRING, value DOUBLE", bronze, f"{bronze}-checkpoint").awaitTermination()
    return spark.read.parquet(bronze).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.max("value").alias("largest"))


def frames_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "frames")
    rows = frames(spark, sf_dir).select("run_id", F.lit("2026-01-01T00:00:00Z").alias("observed_at"), "kind", "connection_id", "data", "row_pos")
    tables.write_jsonl(rows, path)
    return S.sequenced(S.parse_frames(S.drop_heartbeats(S.read_frames(spark, path)))).select("run_id", "connection_id", "sid", "row_pos", "seq")


def run_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per customer: requests are orders, errors and warnings follow their totals."""
    orders = table(spark, sf_dir, "orders").select(text("o_custkey").alias("run_id"), "o_orderkey", "o_totalprice", (F.col("o_orderkey") % 5).alias("k"))
    errors = orders.filter("o_totalprice > 300000").select("run_id", F.concat(F.lit("op"), "k").alias("operation"), F.lit("refused").alias("error"))
    warnings = orders.filter("o_totalprice < 5000").select("run_id", F.concat(F.lit("low"), "k").alias("warning"))
    runs = table(spark, sf_dir, "customer").select(
        text("c_custkey").alias("run_id"), F.lit("2026-01-01T00:00:00Z").alias("started_at"), F.lit("2026-01-01T00:05:00Z").alias("finished_at"),
        F.to_json(F.struct("c_nationkey")).alias("settings"), F.lit(False).alias("fatal"),
    )
    found = audit.run_manifests(runs, orders, errors, warnings)
    listed = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[k].cast("string") for k in f])), ",")
    return found.select("run_id", "settings", "request_count", "status", "exit_code", listed("errors", "operation", "error", "times").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def default_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range per order: some name a start, some an end, the others take the week before the run."""
    day = epoch("o_orderdate")
    start, end = F.when(F.col("o_custkey") % 3 == 0, day - 86400), F.when(F.col("o_custkey") % 2 == 0, day)
    lo, hi = timewindows.default_range(start, end, day + 3600)
    return table(spark, sf_dir, "orders").select("o_orderkey", lo.alias("start_ts"), hi.alias("end_ts"))


_DAY = "CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT)"
QUERIES = [
    Query("jsonl_roundtrip", jsonl_roundtrip, "SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 THEN o_totalprice END AS price, CAST(o_custkey AS VARCHAR) || ',' || o_orderstatus AS tags FROM orders"),
    Query(
        "csv_exported",
        csv_exported,
        """SELECT c_custkey, '''=' || c_mktsegment AS formula, '["' || c_name || '"]' AS names FROM customer UNION ALL SELECT count(*), 'manifest', NULL FROM customer""",
    ),
    Query("bronze_ingested", bronze_ingested, "SELECT event_type AS run_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, max(value) AS largest FROM events GROUP BY 1"),
    Query(
        "frames_landed",
        frames_landed,
        """SELECT event_type AS run_id, day(ts) AS connection_id, CAST(event_id % 8 AS VARCHAR) AS sid, event_id AS row_pos, event_id // 8 AS seq FROM events
        WHERE event_id % 101 > 0 AND event_id % 103 > 0 AND event_id % 53 > 0 AND event_id % 47 > 0 AND event_id % 211 > 0 AND event_id % 43 > 0 AND event_id % 5 > 0""",
    ),
    Query(
        "run_manifests",
        run_manifests,
        """WITH e AS (SELECT o_custkey AS k, count(*) AS n, string_agg(x, ',' ORDER BY x) AS errors FROM (SELECT o_custkey, 'op' || CAST(o_orderkey % 5 AS VARCHAR) || ':refused:' || CAST(count(*) AS VARCHAR) AS x FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey, o_orderkey % 5) GROUP BY 1),
        w AS (SELECT o_custkey AS k, string_agg(x, ',' ORDER BY x) AS warnings FROM (SELECT DISTINCT o_custkey, 'low' || CAST(o_orderkey % 5 AS VARCHAR) AS x FROM orders WHERE o_totalprice < 5000) GROUP BY 1),
        r AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
        SELECT CAST(c_custkey AS VARCHAR) AS run_id, '{"c_nationkey":' || CAST(c_nationkey AS VARCHAR) || '}' AS settings, coalesce(r.n, 0) AS request_count,
          CASE WHEN e.k IS NOT NULL OR w.k IS NOT NULL THEN 'partial' ELSE 'complete_within_requested_scope' END AS status, CASE WHEN e.k IS NOT NULL THEN 2 ELSE 0 END AS exit_code,
          coalesce(errors, '') AS errors, coalesce(warnings, '') AS warnings
        FROM customer LEFT JOIN e ON e.k = c_custkey LEFT JOIN w ON w.k = c_custkey LEFT JOIN r ON r.k = c_custkey""",
    ),
    Query(
        "default_ranges",
        default_ranges,
        f"WITH x AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN {_DAY} - 86400 END AS s, CASE WHEN o_custkey % 2 = 0 THEN {_DAY} ELSE {_DAY} + 3600 END AS e FROM orders) SELECT o_orderkey, coalesce(s, e - 604800) AS start_ts, e AS end_ts FROM x",
    ),
]
