"""Unit-root tests from distributed cross-product sums.

Each series is cut into blocks; a task turns one block into the cross-product matrix
of its regression rows (numpy), Spark adds the matrices per key, and a final step
solves a small system per key. Lag orders depend on each series' own length, without
a driver round trip.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebin.functions.special import adf_critical, adf_pvalue, trend_pvalue
from tidebin.operators.common import attach, block_of, to_blocks
from tidebin.operators.signal import all_differences

GRAM_BLOCK_ROWS = 16384


def _regressors(x: np.ndarray, t0: int, start: int, lags: int, n: int, trend: bool) -> np.ndarray:
    """Rows for times >= start of [Δx_t, 1, (t), x_{t-1}, Δx_{t-1} .. Δx_{t-lags}].

    `x[0]` is the value at time t0. The trend is scaled by n to keep sums moderate.
    """
    t = np.arange(max(start, t0 + 1 + lags), t0 + len(x))
    i = t - t0
    dx = np.diff(x)
    cols = [dx[i - 1], np.ones(len(t))]
    if trend:
        cols.append((t - n / 2.0) / n)
    cols.append(x[i - 1])
    cols += [dx[i - 1 - k] for k in range(1, lags + 1)]
    return np.column_stack(cols) if len(t) else np.zeros((0, 3 + trend + lags))


def _block_gram(trend: bool):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def gram(values: pd.Series, first: pd.Series, start: pd.Series, lags: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for x, t0, s, k, size in zip(values, first, start, lags, n):
            rows = _regressors(np.asarray(x, dtype=float), int(t0), int(s), int(k), int(size), trend)
            out.append((rows.T @ rows).ravel().tolist())
        return pd.Series(out)

    return gram


def lag_grams(
    df: DataFrame, keys: Sequence[str], pos: str, col: str, lags: Column, *, trend: bool, size: int = GRAM_BLOCK_ROWS
) -> DataFrame:
    """One row per key: n, lags, the summed cross-product matrix (flattened) and the
    first lags+2 values. `lags` is an expression over the series length `n`.

    Values are centred by the series mean, which leaves the tests unchanged. Nulls may
    only lead or trail; a series with gaps inside raises.
    """
    base = df.select(*keys, pos, F.col(col).cast("double").alias("__y")).filter(F.col("__y").isNotNull())
    stats = (
        base.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("__mean"), F.min(pos).alias("__p0"), F.max(pos).alias("__p1"))
        .withColumn("lags", F.when(F.col("n") == F.col("__p1") - F.col("__p0") + 1, F.greatest(lags, F.lit(0)).cast("int"))
                    .otherwise(F.raise_error(F.lit("series with gaps: fill missing values first")).cast("int")))
    )
    rows = attach(base, stats, keys).select(
        *keys, "n", "lags", (F.col(pos) - F.col("__p0")).alias("__t"), (F.col("__y") - F.col("__mean")).alias("__x")
    )
    margin = F.col("lags") + 1
    blocks = (
        to_blocks(rows, "__t", margin, 0, size)
        .groupBy(*keys, "n", "lags", "__block")
        .agg(F.array_sort(F.collect_list(F.struct("__t", "__x"))).alias("__run"))
        .filter(F.col("__block") <= block_of(F.col("n") - 1, size))
    )
    summed = blocks.select(
        *keys, "n", "lags",
        F.when(F.col("__block") == 0, F.slice(F.col("__run")["__x"], 1, F.col("lags") + 2)).alias("__head"),
        _block_gram(trend)(
            F.col("__run")["__x"], F.col("__run")[0]["__t"],
            F.greatest(F.col("__block") * size, margin.cast("bigint")), F.col("lags"), F.col("n"),
        ).alias("__gram"),
    )
    cells = summed.select(*keys, "n", "lags", F.posexplode("__gram").alias("__i", "__v"))
    grams = (
        cells.groupBy(*keys, "n", "lags", "__i").agg(F.sum("__v").alias("__v"))
        .groupBy(*keys, "n", "lags")
        .agg(F.array_sort(F.collect_list(F.struct("__i", "__v")))["__v"].alias("gram"))
    )
    heads = summed.filter(F.col("__head").isNotNull()).select(*keys, F.col("__head").alias("head"))
    return attach(grams, heads, keys)


def _sweep(gram: np.ndarray, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, inverse of the scaled system and residual sum of squares for the
    regression of variable 0 on variables 1..cols, for a stack of systems."""
    a, b = gram[:, 1 : cols + 1, 1 : cols + 1], gram[:, 1 : cols + 1, 0]
    scale = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-300))
    both = scale[:, :, None] * scale[:, None, :]
    inv = np.linalg.pinv(a / both, hermitian=True) / both
    beta = np.einsum("mij,mj->mi", inv, b)
    return beta, inv, np.maximum(gram[:, 0, 0] - np.einsum("mi,mi->m", b, beta), 0.0)


def _nested_ssr(gram: np.ndarray) -> np.ndarray:
    """Residual sums of squares of the regressions on variables 1..1, 1..2, ... for a stack.

    One Cholesky factor serves all sizes of a system. A stack with a singular system is
    halved until that one is alone; it is solved size by size.
    """
    a, b = gram[:, 1:, 1:], gram[:, 1:, 0]
    scale = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-300))
    try:
        lower = np.linalg.cholesky(a / (scale[:, :, None] * scale[:, None, :]))
        explained = np.cumsum(np.linalg.solve(lower, (b / scale)[:, :, None])[:, :, 0] ** 2, axis=1)
        return np.maximum(gram[:, 0, 0, None] - explained, 0.0)
    except np.linalg.LinAlgError:
        half = len(gram) // 2
        if half:
            return np.concatenate([_nested_ssr(gram[:half]), _nested_ssr(gram[half:])])
        return np.column_stack([_sweep(gram, cols)[2] for cols in range(1, gram.shape[1])])


def _stacks(gram: pd.Series, lags: pd.Series, extra: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lag order, rows and cross-product matrices of the systems of each size."""
    order = lags.to_numpy()
    for k in np.unique(order).tolist():
        rows, width = np.flatnonzero(order == k), k + extra
        yield k, rows, np.array([np.asarray(gram.iloc[i], dtype=float) for i in rows]).reshape(-1, width, width)


def _early_rows(head: np.ndarray, lags: int, maxlag: int) -> np.ndarray:
    """Cross-products of the rows that order `lags` has and order `maxlag` gives up."""
    t = np.arange(lags + 1, maxlag + 1)
    dx = np.diff(head, axis=1)
    cols = [dx[:, t - 1], np.ones((len(head), len(t))), head[:, t - 1], *[dx[:, t - 1 - j] for j in range(1, lags + 1)]]
    x = np.stack(cols, axis=2)
    return np.einsum("mti,mtj->mij", x, x)


_ADF = T.StructType(
    [
        T.StructField("stat", T.DoubleType()),
        T.StructField("pvalue", T.DoubleType()),
        T.StructField("usedlag", T.IntegerType()),
        T.StructField("nobs", T.LongType()),
        T.StructField("crit_1", T.DoubleType()),
        T.StructField("crit_5", T.DoubleType()),
        T.StructField("crit_10", T.DoubleType()),
    ]
)
_TREND = T.StructType([T.StructField("stat", T.DoubleType()), T.StructField("pvalue", T.DoubleType())])


@F.pandas_udf(_ADF)
def _adf_solve(gram: pd.Series, head: pd.Series, n: pd.Series, lags: pd.Series) -> pd.DataFrame:
    out: list[tuple] = [(None,) * 7] * len(n)
    size = n.to_numpy(dtype=float)
    for maxlag, rows, g in _stacks(gram, lags, 3):
        able = (size[rows] - 1 - maxlag > 3) & (g[:, 0, 0] > 0)
        rows, g = rows[able], g[able]
        if not len(rows):
            continue
        ssr = _nested_ssr(g)[:, 1:]  # constant and level, then one more lag each
        varied = (ssr > 0).all(axis=1)
        rows, g, ssr = rows[varied], g[varied], ssr[varied]
        nobs = size[rows, None] - 1 - maxlag
        aic = nobs * (np.log(2 * np.pi) + np.log(ssr / nobs) + 1) + 2 * (np.arange(maxlag + 1) + 2)
        chosen = np.argmin(aic, axis=1)
        for used in np.unique(chosen).tolist():
            # the chosen order is refitted with the early rows it no longer has to give up
            mine = chosen == used
            which = rows[mine]
            first = np.array([np.asarray(head.iloc[i], dtype=float) for i in which])
            beta, inv, rest = _sweep(g[mine][:, : used + 3, : used + 3] + _early_rows(first, used, maxlag), used + 2)
            left = size[which] - 1 - used
            with np.errstate(divide="ignore", invalid="ignore"):
                stats = beta[:, 1] / np.sqrt(rest / (left - used - 2) * inv[:, 1, 1])
            for i, stat, m in zip(which, stats.tolist(), left.astype(int).tolist()):
                if m > used + 2:
                    out[i] = (stat, adf_pvalue(stat), used, m, *adf_critical(m).values())
    return pd.DataFrame(out, columns=_ADF.names).astype({"usedlag": "Int32", "nobs": "Int64"})


def adf_test(df: DataFrame, keys: Sequence[str], pos: str, col: str, maxlag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with constant, lag order by AIC.

    Null results mark series that are too short or have no variation.
    """
    n = F.col("n")
    room = F.floor(n / 2) - 2
    rule = F.ceil(12 * F.pow(n / 100.0, F.lit(0.25))) if maxlag is None else F.lit(maxlag)
    sums = lag_grams(df, keys, pos, col, F.least(rule, room), trend=False)
    return sums.select(*keys, _adf_solve("gram", "head", "n", "lags").alias("r")).select(*keys, "r.*")


@F.pandas_udf(_TREND)
def _trend_solve(gram: pd.Series, n: pd.Series, lags: pd.Series) -> pd.DataFrame:
    out: list[tuple] = [(None, None)] * len(n)
    size = n.to_numpy(dtype=float)
    for k, rows, g in _stacks(gram, lags, 4):
        able = (size[rows] - 1 - k - (k + 3) > 0) & (g[:, 0, 0] > 0)
        rows, g = rows[able], g[able]
        if not len(rows):
            continue
        beta, inv, ssr = _sweep(g, k + 3)
        var = ssr / (size[rows] - 1 - k - (k + 3)) * inv[:, 2, 2]
        for i, b, v in zip(rows, beta[:, 2].tolist(), var.tolist()):
            if v > 0:
                stat = b / v**0.5
                out[i] = (stat, trend_pvalue(stat, int(size[i]) - 1))
    return pd.DataFrame(out, columns=_TREND.names)


def adf_trend_test(df: DataFrame, keys: Sequence[str], pos: str, col: str) -> DataFrame:
    """Dickey-Fuller test with constant and trend, lag order trunc((n-1)^(1/3)),
    p-value interpolated in the published table."""
    # the nudge keeps exact cubes from falling just below the integer
    order = F.floor(F.cbrt((F.col("n") - 1).cast("double")) + 1e-9)
    sums = lag_grams(df, keys, pos, col, order, trend=True)
    return sums.select(*keys, "n", "lags", _trend_solve("gram", "n", "lags").alias("r")).select(*keys, "n", "lags", "r.*")


def ndiffs(
    df: DataFrame, keys: Sequence[str], pos: str, col: str, *, alphas: Sequence[float] = (0.05,), max_d: int = 2
) -> DataFrame:
    """Differences needed until the trend test rejects a unit root, per alpha.

    All candidate orders are tested side by side; a series that never passes gets max_d,
    one without variation needs no further difference.
    """
    tests = adf_trend_test(all_differences(df, keys, pos, col, max_d - 1), [*keys, "d"], pos, "y")
    level = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    passed = F.col("pvalue").isNull() | (F.col("pvalue") <= F.col("alpha"))
    return (
        tests.select(*keys, "d", "pvalue", level)
        .groupBy(*keys, "alpha")
        .agg(F.coalesce(F.min(F.when(passed, F.col("d"))), F.lit(max_d)).alias("d"))
    )


def stationary_signal(
    df: DataFrame, keys: Sequence[str], pos: str, col: str, *, alpha: float = 0.05, max_d: int = 2
) -> DataFrame:
    """Each series differenced as often as `ndiffs` asks: `(keys, d, pos, y)`."""
    chosen = ndiffs(df, keys, pos, col, alphas=(alpha,), max_d=max_d).select(*keys, F.col("d").alias("__d"))
    signals = all_differences(df, keys, pos, col, max_d)
    return attach(signals, chosen, keys).filter(F.col("d") == F.col("__d")).drop("__d")
