"""Ordered operations that survive a hot key.

A plain window sends every row of a key to one task. Here a key's rows are first cut into
position buckets of a fixed width, so a window never holds more than ``width`` positions of
one key; one small row per bucket then carries totals or last values across bucket borders.
``pos`` must be a BIGINT, unique within the key, and keys must be non-null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUCKET_WIDTH = 1_000_000
_BUCKET = "__bucket"


def _bucketed(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn(_BUCKET, F.floor(F.col(pos) / F.lit(width)))


def running_sum(
    df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, width: int = BUCKET_WIDTH
) -> DataFrame:
    """Add ``out``: inclusive running total of ``value`` within ``keys`` in ``pos`` order."""
    keys = list(keys)
    rows = _bucketed(df.withColumn("__value", F.coalesce(value.cast("bigint"), F.lit(0))), pos, width)
    before = W.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, _BUCKET)
        .agg(F.sum("__value").alias("__total"))
        .select(*keys, _BUCKET, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__carry"))
    )
    inside = W.partitionBy(*keys, _BUCKET).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("__inside", F.sum("__value").over(inside))
        .join(carried, [*keys, _BUCKET], "left")
        .withColumn(out, F.col("__inside") + F.col("__carry"))
        .select(*df.columns, out)
    )


def row_number_ordered(df: DataFrame, keys: Sequence[str], pos: str, out: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """Add ``out``: 1, 2, 3 … within ``keys`` in ``pos`` order."""
    return running_sum(df, keys, pos, F.lit(1), out, width)


def lag_ordered(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, width: int = BUCKET_WIDTH
) -> DataFrame:
    """Add ``out``: the non-null ``value`` of the preceding row of the key, null for its first row."""
    keys = list(keys)
    rows = _bucketed(df, pos, width)
    carried = (
        rows.groupBy(*keys, _BUCKET)
        .agg(F.max_by(value, pos).alias("__last"))
        .select(*keys, _BUCKET, F.lag("__last").over(W.partitionBy(*keys).orderBy(_BUCKET)).alias("__carry"))
    )
    inside = W.partitionBy(*keys, _BUCKET).orderBy(pos)
    return (
        rows.withColumn("__inside", F.lag(value).over(inside))
        .join(carried, [*keys, _BUCKET], "left")
        .withColumn(out, F.coalesce("__inside", "__carry"))
        .select(*df.columns, out)
    )


def latest_by(
    df: DataFrame,
    keys: Sequence[str],
    pos: Column,
    keep: str = "last",
    copies: str | None = None,
    first_pos: str | None = None,
    more: Mapping[str, Column] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the last (or first) by ``pos``, an orderable unique expression.

    Built as an aggregate, so copies of a hot key collapse on the map side. ``copies`` adds
    the number of rows behind each key, ``first_pos`` the position of the first of them, ``more``
    other aggregates over them. Columns of ``drop`` only order the rows and are not carried along.
    """
    if keep not in ("last", "first"):
        raise ValueError("keep must be 'last' or 'first'")
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c not in drop]
    pick = F.max_by if keep == "last" else F.min_by
    aggregates = [pick(F.struct(*rest) if rest else F.lit(1), pos).alias("__row")]
    if copies:
        aggregates.append(F.count(F.lit(1)).alias(copies))
    if first_pos:
        aggregates.append(F.min(pos).alias(first_pos))
    aggregates += [column.alias(name) for name, column in (more or {}).items()]
    extra = [c for c in (copies, first_pos, *(more or {})) if c]
    picked = df.groupBy(*keys).agg(*aggregates)
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest], *extra)
