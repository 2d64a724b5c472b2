"""Means and central cross-moments of a few columns in one aggregate.

Least squares, correlation and partial correlation all start from these numbers, so
rows are read once and never leave the JVM. `covar_pop` updates central moments
directly, which avoids the cancellation of raw sums of squares.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment_columns(cols: Sequence[Column], where: Column | None = None) -> list[Column]:
    """Aggregates `n`, `mean` and `cov` (row-major, full matrix) over the listed columns.

    Rows with a null in any of them, or outside `where`, do not count.
    """
    complete = F.lit(True) if where is None else where
    for c in cols:
        complete = complete & c.isNotNull()
    x = [F.when(complete, c.cast("double")) for c in cols]
    pair = {(i, j): F.covar_pop(x[i], x[j]) for i in range(len(x)) for j in range(i, len(x))}
    full = [pair[min(i, j), max(i, j)] for i in range(len(x)) for j in range(len(x))]
    return [
        F.count(F.when(complete, F.lit(1))).alias("n"),
        F.array(*[F.avg(c) for c in x]).alias("mean"),
        F.array(*full).alias("cov"),
    ]


def moments(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*moment_columns([F.col(c) for c in cols]))
