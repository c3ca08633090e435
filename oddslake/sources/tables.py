"""Reading landed JSON lines and writing tables: JSON lines, safe CSV, partitioned Parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from oddslake.functions import csv_safe_column


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, a bad line stops the job.

    A stored ``row_pos`` is kept. Without one, rows are numbered in scan order, which is the
    line order of a single file.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if "row_pos" in rows.columns:
        return rows
    return rows.withColumn("row_pos", F.monotonically_increasing_id())


def with_row_pos(df: DataFrame, *order: Column | str, out: str = "row_pos") -> DataFrame:
    """Number rows by a total order, in parallel: ids grow with the range-sorted partitions.

    Ids are increasing and unique but not dense. Write the result before using it, so that
    every later plan reads the same numbers.
    """
    return df.orderBy(*order).withColumn(out, F.monotonically_increasing_id())


def _has_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def reject_nan(df: DataFrame) -> DataFrame:
    """Stop the job on NaN or an infinity in a floating column: JSON has no such numbers."""
    checks = {}
    for field in df.schema:
        if _has_float(field.dataType):
            bad = F.isnan(field.name) | (F.abs(F.col(field.name)) == float("inf"))
            refuse = F.raise_error(F.lit(f"not a JSON number in {field.name}")).cast(field.dataType)
            checks[field.name] = F.when(bad, refuse).otherwise(F.col(field.name))
    return df.withColumns(checks) if checks else df


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    reject_nan(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def json_document(df: DataFrame, out: str = "document") -> DataFrame:
    """Rows as JSON documents, for one-row summaries."""
    return reject_nan(df).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(out))


def csv_safe(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, formula-leading text neutralized, numbers untouched."""
    columns = []
    for field in df.schema:
        value = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value)
            columns.append(csv_safe_column(value).alias(field.name))
        elif isinstance(field.dataType, T.StringType):
            columns.append(csv_safe_column(value).alias(field.name))
        else:
            columns.append(value)
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", bom: bool = False) -> None:
    """CSV parts with a header; ``bom`` starts each part with a byte-order mark."""
    safe = csv_safe(df)
    header = [c for c in safe.columns]
    if bom and header:
        safe = safe.withColumnRenamed(header[0], "\ufeff" + header[0])
    safe.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def ingest(
    spark: SparkSession,
    landing: str,
    schema: str | T.StructType,
    table_path: str,
    checkpoint_path: str,
    partition_by: Sequence[str] = ("run_id",),
) -> StreamingQuery:
    """Append newly landed JSON-line files to a bronze table, each file exactly once.

    Takes what has arrived and ends; run it again, or with a longer trigger, as files land.
    """
    rows = spark.readStream.schema(schema).json(landing)
    return (
        rows.writeStream.format("parquet")
        .partitionBy(*partition_by)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start(table_path)
    )


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "append") -> None:
    """Parquet, partitioned by the given columns (run and venue for bronze and silver tables)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def export_tables(
    tables: Mapping[str, DataFrame], root: str, raw: DataFrame | None = None, manifest: DataFrame | None = None
) -> None:
    """Each named table as CSV under ``root``, with the raw log and the manifest as JSON lines."""
    for name, df in tables.items():
        write_csv(df, f"{root}/{name}")
    for name, df in (("raw_responses", raw), ("manifest", manifest)):
        if df is not None:
            write_jsonl(df, f"{root}/{name}")


def preview(rows: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Project dotted paths to flat columns; a path the schema lacks becomes null."""
    def exists(path: str) -> bool:
        kind: T.DataType = rows.schema
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return False
            kind = kind[part].dataType
        return True

    flat = rows.select(
        *[(F.col(p) if exists(p) else F.lit(None).cast("string")).alias(p.replace(".", "_")) for p in columns]
    )
    return flat.limit(limit) if limit is not None else flat
