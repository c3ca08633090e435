"""Column helpers the operators of this package share."""

from __future__ import annotations

import shutil
import string
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Separators of words: space and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


#: Bytes of a batch between Spark and a Python worker; two are in memory on each side.
BATCH_BYTES = "16m"
_SHIPPED: set[str] = set()


def with_package(spark: SparkSession) -> SparkSession:
    """Give this package to the Python workers of the session's application, once, and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Bound the batches between Spark and Python workers for the jobs run inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Runs of characters that are no separator, in order; empty for a blank text."""
    body = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).otherwise(F.split(body, BLANK_RUN))


def held_out(column: str, modulus: int, remainder: int = 2) -> Column:
    """Whether the checksum of the id as text falls into the part that is kept from learning."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))


def numbered(df: DataFrame, keys: Sequence[str], spread: Column, order: Sequence[str], out: str, parts: int) -> DataFrame:
    """Add ``out``: 0, 1, 2 … without a gap within ``keys``, though no task sees a whole key.

    ``spread`` deals the rows of a key over ``parts``; rows are numbered in their part, and the
    parts' sizes, ``parts`` rows a key, are added up. ``df`` must give the same rows on each read.
    """
    rows = df.withColumn("__part", F.pmod(spread, F.lit(parts)).cast("int"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = (
        rows.groupBy(*keys, "__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    )
    inside = F.row_number().over(W.partitionBy(*keys, "__part").orderBy(*order))
    return (
        rows.withColumn("__row", inside)
        .join(base, [*keys, "__part"])
        .withColumn(out, F.col("__base") + F.col("__row") - 1)
        .select(*df.columns, out)
    )
