"""Correlation and partial correlation of aligned series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebin.operators.moments import moments


def pearson_matrix(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Lower triangle with diagonal as rows `(keys, x, y, r)`; null where a column is constant."""
    k = len(cols)
    names = F.array(*[F.lit(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(k) for j in range(i + 1)])
    cells = moments(df, cols, keys).select(*keys, "cov", F.inline(pairs))
    i, j, cov = F.col("i"), F.col("j"), F.col("cov")
    scale = F.sqrt(cov[i * k + i]) * F.sqrt(cov[j * k + j])
    r = F.when(scale > 0, F.when(i == j, F.lit(1.0)).otherwise(cov[i * k + j] / F.nullif(scale, F.lit(0.0))))
    return cells.select(*keys, names[i].alias("x"), names[j].alias("y"), r.alias("r"))


def corr_with_target(df: DataFrame, target: str, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of each numeric column with the target; order by `r` for a ranking."""
    x = F.col(target).cast("double")
    aggs = []
    for c in cols:
        y = F.col(c).cast("double")
        both = x.isNotNull() & y.isNotNull()
        spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
        aggs.append((F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))).alias(c))
    return df.groupBy(*keys).agg(*aggs).unpivot(list(keys), list(cols), "variable", "r")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _partial(flat: pd.Series, n: pd.Series) -> pd.Series:
    """Partial correlation of variable 0 with each other one, given the rest; a stack at once."""
    if not len(flat):
        return pd.Series([], dtype=object)
    c = np.array([np.asarray(cells, dtype=float) for cells in flat])
    k = math.isqrt(c.shape[1])
    c = c.reshape(-1, k, k)
    scale = np.sqrt(np.maximum(np.diagonal(c, axis1=1, axis2=2), 0.0))
    fits = np.flatnonzero((n.to_numpy() > k) & (scale > 0).all(axis=1))
    out = [[None] * (k - 1)] * len(c)
    if len(fits):
        p = np.linalg.pinv(c[fits] / (scale[fits, :, None] * scale[fits, None, :]), hermitian=True)
        r = -p[:, 0, 1:] / np.sqrt(p[:, 0, :1] * np.diagonal(p, axis1=1, axis2=2)[:, 1:])
        for i, row in zip(fits, r.tolist()):
            out[i] = row
    return pd.Series(out)


def partial_corr(df: DataFrame, target: str, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of the target with each column, controlling for all other columns."""
    m = moments(df, [target, *cols], keys).withColumn("__r", _partial("cov", "n"))
    names = F.array(*[F.lit(c) for c in cols])
    return m.select(*keys, F.posexplode("__r").alias("i", "r")).select(*keys, names[F.col("i")].alias("variable"), "r")
