"""Vectors of whole numbers that the operators on embeddings start from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import pick


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its entries are numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def vectors(table: DataFrame) -> DataFrame:
    """vec_id and vector (double) of the rows whose vector is there and finite."""
    rows = pick(table, vec_id="long", embedding="array<double>").withColumnRenamed("embedding", "vector")
    return rows.where(finite(F.col("vector")))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a batch, all of one length and without nulls."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def exact(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits where no sum of squared differences can be too large, else Python's own."""
    small = not x.size or max(abs(int(x.max())), abs(int(x.min()))) <= 1 << 27
    return x.astype(np.int64 if small else object)


def long_or_none(v: object) -> int | None:
    """A whole number, or None if it's beyond what a long holds."""
    v = int(v)
    return v if -(1 << 63) <= v < 1 << 63 else None
