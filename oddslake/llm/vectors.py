"""Vector columns as matrices of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` of the rows whose vector is there, has entries, and only finite ones."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return df.where(F.coalesce((F.size(vector) > 0) & finite, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), vector.alias("vector"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, without nulls, as a matrix."""
    if not len(column):
        return np.empty((0, 0))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
