"""Columns that are evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns in a projection that later filters do not pass.

    A filter on a projected column is pushed below the projection by copying its expression,
    so a parse or a set of patterns would run once for the filter and once for the result. Here
    a one-row generator, which only hands the finished values on, stands in between: filters on
    these columns stay above it, filters on other columns still go down.
    """
    names = {f"__raw_{n}": n for n in columns}
    projected = df.select("*", *[c.alias(f"__raw_{n}") for n, c in columns.items()])
    handed_on = F.inline(F.array(F.struct(*[F.col(raw).alias(n) for raw, n in names.items()])))
    return projected.select(*df.columns, handed_on)


def fenced(df: DataFrame, *outside: str) -> DataFrame:
    """The same rows; filters go below this only on the columns named ``outside``.

    As in :func:`computed`, but for the results of a whole chain of projections, each of which needs no generator then.
    """
    inside = [c for c in df.columns if c not in outside]
    return df.select(*outside, F.inline(F.array(F.struct(*inside))))
