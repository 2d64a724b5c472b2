"""Vector columns: which rows take part, and batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, without null or non-finite parts, and not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def valid(df: DataFrame, vec_id: str, vector: str, *more: str) -> DataFrame:
    """`vec_id` long and `vec` array<double> of the rows that take part; the most frequent
    length of vectors is the length that counts."""
    rows = df.filter(F.col(vec_id).isNotNull() & usable(vector))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"), *more)
    size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.filter(F.size("vec") == (size["size"] if size else 0))


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width or (len(flat) // len(column) if len(column) else 0)).astype(np.float64, copy=False)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest part first, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
