"""Reading vector columns for the operators on embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null or empty, every component a finite number, not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def padded(df: DataFrame, vector: str) -> DataFrame:
    """The column as doubles, shorter vectors filled with zeros to the longest."""
    width = df.agg(F.max(F.size(vector))).first()[0] or 0
    return df.withColumn(vector, F.concat(F.col(vector).cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(width) - F.size(vector))))


def matrix(column) -> np.ndarray:
    """A pandas column of equally long arrays as a matrix."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow."""
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
