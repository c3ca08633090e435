"""Joins that keep their balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(
    many: DataFrame, one: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Join rows to a side that is unique per key; a key with a large part of the rows is spread over tasks.

    Both sides are sorted and merged, never sent whole to the driver: the unique side has a row per key and
    grows with the data. Adaptive execution splits a partition that a hot key swells and reads the one row
    of that key again for every piece, so no key is copied in advance. With ``salts`` each key is spread
    over that many tasks whatever the session does, at the price of as many copies of the unique side;
    ``spread`` is then a column of ``many`` that varies within a key.
    """
    if salts is None:
        return many.join(one.hint("merge"), list(keys), how)
    left = many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*keys, "__salt"], how).drop("__salt")
