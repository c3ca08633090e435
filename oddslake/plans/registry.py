"""A registered query: its name, how to build it, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.session import prepare

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(prepare(spark), sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are worth much work each, dealt over the cores before that work.

    A scan has one task per row group at most, and a row group may hold millions of narrow rows, each of which
    becomes a payload to parse. The dealt columns are those of the scan, so the shuffle is about as large as the table.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, name).repartition(parts)


def text(column: str) -> Column:
    return F.col(column).cast("string")


def join_text(column: str | Column) -> Column:
    """Array of strings as one comma-separated string, so results compare as plain values."""
    return F.array_join(column, ",")


def epoch(column: str) -> Column:
    """Whole seconds of a zone-less timestamp read as UTC."""
    return F.unix_seconds(F.col(column).cast("timestamp"))


def json_text(**fields: Column) -> Column:
    """JSON object text from already rendered JSON values, keys in the given order."""
    return F.concat(F.lit("{"), json_members(**fields), F.lit("}"))


def json_members(**fields: Column) -> Column:
    """The members of such an object, without its braces."""
    parts = []
    for i, (name, value) in enumerate(fields.items()):
        parts += [F.lit(("" if i == 0 else ",") + f'"{name}":'), value]
    return F.concat(*parts)


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
