"""Shared parts of the vector operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: str) -> Column:
    """Vectors with components, all finite, not all zero."""
    c = F.col(embedding)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def prepared(rows: DataFrame, *more: str) -> DataFrame:
    """Usable vectors with an id, their length, and their components as the bytes of doubles are made from floats."""
    return rows.where(F.col("vec_id").isNotNull() & usable("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), *more, F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("embedding")
    )


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in doubles, summed in the order of the components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total
