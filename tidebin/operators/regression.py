"""Least squares with a constant, evaluated on held-out intervals.

Fits need only the means and central cross-moments of the columns, which Spark sums in
one aggregate per key; a k-by-k system per key is solved in the task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebin.functions.special import student_t_pvalues
from tidebin.operators.common import BLOCK, attach, block_of, block_window
from tidebin.operators.moments import moment_columns
from tidebin.operators.ordering import random_share

CONST = "const"


def scale_stats(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.min(c).cast("double").alias(f"__min_{c}") for c in cols],
        *[F.max(c).cast("double").alias(f"__max_{c}") for c in cols],
    )


def _range_of(c: str) -> Column:
    """Width of a column's range; a constant column is only shifted, not scaled."""
    width = F.col(f"__max_{c}") - F.col(f"__min_{c}")
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def minmax_scale(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), *, stats: DataFrame | None = None) -> DataFrame:
    """Scale columns to [0, 1] over all rows, or by the given statistics."""
    stats = scale_stats(df, cols, keys) if stats is None else stats
    scaled = {c: (F.col(c) - F.col(f"__min_{c}")) / _range_of(c) for c in cols}
    return attach(df, stats, keys).withColumns(scaled).drop(*[f"__{m}_{c}" for m in ("min", "max") for c in cols])


def minmax_inverse(df: DataFrame, col: str, source: str, stats: DataFrame, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Back from [0, 1] to the units of `source`."""
    value = F.col(col) * _range_of(source) + F.col(f"__min_{source}")
    wide = attach(df, stats.select(*keys, f"__min_{source}", f"__max_{source}"), keys)
    return wide.withColumn(out or col, value).drop(f"__min_{source}", f"__max_{source}")


def split_chronological(df: DataFrame, pos: str, keys: Sequence[str] = (), *, train: float = 0.8, out: str = "is_train") -> DataFrame:
    """The first `int(train*n)` rows of each key by position train, whatever gaps there are.

    Rows are ranked within blocks of positions, and blocks by the rows before them, so no
    task orders a whole series."""
    rows = df.withColumn(BLOCK, block_of(pos))
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    sizes = rows.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__size").over(Window.partitionBy(*keys))
    stats = sizes.select(*keys, BLOCK, before.alias("__before"), total.alias("__n"))
    rank = F.col("__before") + F.row_number().over(block_window(keys, pos))
    flag = rank <= F.floor(F.col("__n") * F.lit(train))
    return attach(rows, stats, [*keys, BLOCK]).withColumn(out, flag).drop("__before", "__n", BLOCK)


def split_random(
    df: DataFrame, ids: Sequence[str], keys: Sequence[str] = (), *, test: float = 0.2, seed: int = 0, out: str = "is_train"
) -> DataFrame:
    """Exactly `ceil(test*n)` rows of each key test, chosen by a seeded hash order."""
    return random_share(df, ids, seed, test, keys, out).withColumn(out, ~F.col(out))


_FIT = T.StructType(
    [
        T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("se", T.ArrayType(T.DoubleType())),
        T.StructField("t", T.ArrayType(T.DoubleType())),
        T.StructField("p", T.ArrayType(T.DoubleType())),
        T.StructField("r2", T.DoubleType()),
        T.StructField("adj_r2", T.DoubleType()),
        T.StructField("aic", T.DoubleType()),
        T.StructField("df_resid", T.LongType()),
    ]
)


def solve(n: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slopes, constant, inverse of the centred cross-products and residual sum of squares
    of variable 0 on the others, for a stack of systems of one size. Redundant columns share
    their effect (pseudo-inverse)."""
    a, b = n[:, None, None] * cov[:, 1:, 1:], n[:, None] * cov[:, 1:, 0]
    scale = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 0.0))
    scale[scale == 0] = 1.0
    both = scale[:, :, None] * scale[:, None, :]
    inv = np.linalg.pinv(a / both, rcond=1e-13, hermitian=True) / both if a.size else a
    slopes = np.einsum("mij,mj->mi", inv, b)
    ssr = np.maximum(n * cov[:, 0, 0] - np.einsum("mi,mi->m", b, slopes), 0.0)
    return slopes, mean[:, 0] - np.einsum("mi,mi->m", slopes, mean[:, 1:]), inv, ssr


def stacked(mean: pd.Series, cov: pd.Series, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The moments of the chosen rows, which have equal sizes, as arrays."""
    means = np.array([np.asarray(mean.iloc[i], dtype=float) for i in where])
    k = means.shape[1]
    return means, np.array([np.asarray(cov.iloc[i], dtype=float) for i in where]).reshape(-1, k, k)


@F.pandas_udf(_FIT)
def _fit(n: pd.Series, mean: pd.Series, cov: pd.Series) -> pd.DataFrame:
    out: list = [(None,) * len(_FIT.names)] * len(n)
    where = np.array([i for i, (size, m) in enumerate(zip(n, mean)) if size > len(m) and not any(v is None for v in m)], dtype=int)
    if len(where):
        means, covs = stacked(mean, cov, where)
        size, k = n.to_numpy()[where].astype(float), means.shape[1]
        slopes, const, inv, ssr = solve(size, means, covs)
        dof = size - k
        sigma2 = ssr / dof
        spread = np.einsum("mi,mij,mj->m", means[:, 1:], inv, means[:, 1:])
        var = np.column_stack([np.diagonal(inv, axis1=1, axis2=2), 1.0 / size + spread]) * sigma2[:, None]
        coef = np.column_stack([slopes, const])
        se = np.sqrt(np.maximum(var, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = coef / se
            p = student_t_pvalues(t, np.broadcast_to(dof[:, None], t.shape))
            sst = size * covs[:, 0, 0]
            r2 = 1.0 - ssr / sst
            adj = 1.0 - (1.0 - r2) * (size - 1) / dof
            aic = size * (np.log(2 * np.pi) + np.log(ssr / size) + 1) + 2 * k
        for j, i in enumerate(where):
            known = sst[j] > 0
            out[i] = (
                coef[j].tolist(), se[j].tolist(), t[j].tolist(), p[j].tolist(), r2[j] if known else None,
                adj[j] if known else None, aic[j] if ssr[j] > 0 else None, int(dof[j]),
            )
    return pd.DataFrame(out, columns=_FIT.names).astype({"df_resid": "Int64"})


def ols_fit(
    df: DataFrame, target: str, regressors: Sequence[str], keys: Sequence[str] = (), *, where: Column | None = None
) -> DataFrame:
    """One row per key: n, `coef`, `se`, `t`, `p` (regressors in order, constant last),
    r2, adj_r2, aic and residual degrees of freedom."""
    sums = df.groupBy(*keys).agg(*moment_columns([F.col(c) for c in (target, *regressors)], where))
    return sums.select(*keys, "n", _fit("n", "mean", "cov").alias("f")).select(*keys, "n", "f.*")


def ols_inference(fit: DataFrame, regressors: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The fit as one row per term."""
    terms = F.array(*[F.lit(name) for name in (*regressors, CONST)])
    rows = fit.select(*keys, "n", "r2", "adj_r2", "aic", F.posexplode(F.arrays_zip("coef", "se", "t", "p")).alias("i", "e"))
    return rows.select(*keys, "n", "r2", "adj_r2", "aic", terms[F.col("i")].alias("term"), "e.*")


def ols_predict(df: DataFrame, fit: DataFrame, regressors: Sequence[str], keys: Sequence[str] = (), out: str = "predicted") -> DataFrame:
    """Linear combination as a column expression."""
    wide = attach(df, fit.select(*keys, F.col("coef").alias("__coef")), keys)
    value = F.col("__coef")[len(regressors)]
    for i, c in enumerate(regressors):
        value = value + F.col("__coef")[i] * F.col(c)
    return wide.withColumn(out, value).drop("__coef")


def error_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str]) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


class HoldoutFit(NamedTuple):
    """Fit (scaled units), errors and predictions (target units) of one evaluation."""

    fit: DataFrame
    metrics: DataFrame
    predictions: DataFrame


def fit_holdout(
    df: DataFrame,
    target: str,
    regressors: Sequence[str],
    *,
    keys: Sequence[str] = (),
    split: str = "chronological",
    pos: str = "bin_idx",
    ids: Sequence[str] | None = None,
    test: float = 0.2,
    seed: int = 0,
    fit_on: str = "all",
) -> HoldoutFit:
    """Scale to [0, 1], split, fit on the training rows, and report errors in target units.

    `split` is "chronological" (first rows train) or "random" (exact share, seeded).
    `fit_on="train"` scales by training rows only, which leaks nothing from the test rows.
    The table is read several times: pass a settled one.
    """
    if split not in ("chronological", "random"):
        raise ValueError(f"unknown split: {split}")
    cols = [target, *regressors]
    rows = df.dropna("any", subset=cols).withColumn("actual", F.col(target).cast("double"))
    if split == "random":
        rows = split_random(rows, ids or [pos], keys, test=test, seed=seed)
    else:
        rows = split_chronological(rows, pos, keys, train=1.0 - test)
    fitted = rows.filter("is_train") if fit_on == "train" else df.dropna("any", subset=cols)
    stats = scale_stats(fitted, cols, keys)
    scaled = minmax_scale(rows, cols, keys, stats=stats)
    fit = ols_fit(scaled, target, regressors, keys, where=F.col("is_train"))
    predictions = minmax_inverse(ols_predict(scaled, fit, regressors, keys), "predicted", target, stats, keys).select(
        *dict.fromkeys([*keys, *([pos] if pos in df.columns else []), *(ids or [])]), "is_train", "actual", "predicted"
    )
    sample = F.when(F.col("is_train"), "in_sample").otherwise("out_of_sample")
    metrics = error_metrics(predictions.withColumn("sample", sample), "actual", "predicted", [*keys, "sample"])
    return HoldoutFit(fit, metrics, predictions)
