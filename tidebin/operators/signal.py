"""Series operators on evenly spaced, consecutive positions.

Differences, moving-average decomposition and autocorrelation use blocked lags
(`common.with_lags`); everything that is summed is summed by Spark. Only the lag
curve of a key, at most a few dozen numbers, is handled as an array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebin.operators.common import attach, block_window, own_rows, to_blocks, with_lags

Z95 = 1.959963984540054  # two-sided 5 % point of the normal distribution


def difference(df: DataFrame, keys: Sequence[str], pos: str, col: str, order: int = 1, out: str | None = None) -> DataFrame:
    """First or second difference; rows without a value, at the start and after gaps, are dropped."""
    out = out or col
    if order == 0:
        return df.withColumn(out, F.col(col))
    lagged = with_lags(df, keys, pos, {f"__l{k}": (col, k) for k in range(1, order + 1)})
    value = difference_of([F.col(col), *[F.col(f"__l{k}") for k in range(1, order + 1)]], order)
    return (
        lagged.withColumn(out, value)
        .filter(F.col(out).isNotNull())
        .drop(*[f"__l{k}" for k in range(1, order + 1)])
    )


def difference_of(levels: Sequence[Column], order: int) -> Column:
    """Difference of the given order from the current level and its lags."""
    if order == 0:
        return levels[0]
    return difference_of(levels[:-1], order - 1) - difference_of(levels[1:], order - 1)


def all_differences(df: DataFrame, keys: Sequence[str], pos: str, col: str, max_order: int = 2) -> DataFrame:
    """Long table `(keys, d, pos, y)` with the series differenced 0..max_order times."""
    lagged = with_lags(
        df.select(*keys, pos, F.col(col).cast("double").alias("__y")),
        keys, pos, {f"__l{k}": ("__y", k) for k in range(1, max_order + 1)},
    )
    levels = [F.col("__y"), *[F.col(f"__l{k}") for k in range(1, max_order + 1)]]
    options = F.array(
        *[F.struct(F.lit(d).alias("d"), difference_of(levels[: d + 1], d).alias("y")) for d in range(max_order + 1)]
    )
    return lagged.select(*keys, pos, F.inline(options)).filter(F.col("y").isNotNull()).select(*keys, "d", pos, "y")


def centered_trend(df: DataFrame, keys: Sequence[str], pos: str, col: str, period: int = 12, out: str = "trend") -> DataFrame:
    """Centred moving average of one period; an even period gives its two end points
    half weight. Null where the frame is not full, at the ends and around gaps."""
    half = period // 2
    w = block_window(keys, pos)
    inner = half - 1 if period % 2 == 0 else half
    frame = w.rangeBetween(-inner, inner)
    total = F.sum(col).over(frame)
    full = F.count(col).over(frame) == 2 * inner + 1
    if period % 2 == 0:
        total = total + 0.5 * (F.first(col).over(w.rangeBetween(-half, -half)) + F.first(col).over(w.rangeBetween(half, half)))
    blocks = to_blocks(df, pos, half, half).withColumn(out, F.when(full, total / F.lit(float(period))))
    return own_rows(blocks, pos)


def decompose_additive(df: DataFrame, keys: Sequence[str], pos: str, col: str, period: int = 12) -> DataFrame:
    """Observed = trend + seasonal + resid.

    The seasonal part is the mean of the detrended values per `pos % period`, centred
    over the period; it does not depend on where the counting of positions starts.
    """
    base = df.select(*keys, pos, F.col(col).cast("double").alias("observed"))
    phase = F.pmod(F.col(pos), F.lit(period).cast("bigint"))
    rows = centered_trend(base, keys, pos, "observed", period).withColumn("__phase", phase)
    means = rows.groupBy(*keys, "__phase").agg(F.avg(F.col("observed") - F.col("trend")).alias("__m"))
    # `period` rows per key
    centred = F.col("__m") - F.avg("__m").over(Window.partitionBy(*keys))
    seasonal = means.select(*keys, "__phase", centred.alias("seasonal"))
    return (
        attach(rows, seasonal, [*keys, "__phase"])
        .drop("__phase")
        .withColumn("resid", F.col("observed") - F.col("trend") - F.col("seasonal"))
    )


def _levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of many lag curves at once (one row per series)."""
    m, width = r.shape
    out = np.full((m, width), np.nan)
    out[:, 0] = r[:, 0]
    phi = np.zeros((m, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(1, width):
            back = r[:, k - 1 : 0 : -1]
            num = r[:, k] - (phi * back).sum(axis=1)
            den = 1.0 - (phi * r[:, 1:k]).sum(axis=1)
            last = num / den
            phi = np.hstack([phi - last[:, None] * phi[:, ::-1], last[:, None]])
            out[:, k] = last
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _pacf_curve(curves: pd.Series) -> pd.Series:
    out: list = [None] * len(curves)
    lengths = curves.map(len)
    for width in lengths.unique():
        where = np.flatnonzero(lengths == width)
        r = np.array([list(curves.iloc[i]) for i in where], dtype=float)
        for i, row in zip(where, _levinson(r)):
            out[i] = [None if np.isnan(v) else float(v) for v in row]
    return pd.Series(out)


def _lag_curves(df, keys, pos, col, nlags):
    """One row per key: n and the autocorrelations 0..min(nlags, n-1) as an array.

    Null values keep their position and take no part in the sums.
    """
    base = df.select(*keys, pos, F.col(col).cast("double").alias("__y"))
    stats = base.groupBy(*keys).agg(F.count("__y").alias("n"), F.avg("__y").alias("__mean"))
    centred = attach(base, stats, keys).withColumn("__z", F.col("__y") - F.col("__mean"))
    lagged = with_lags(centred, keys, pos, {f"__l{k}": ("__z", k) for k in range(1, nlags + 1)})
    z = F.col("__z")
    sums = [F.sum(z * z)] + [F.coalesce(F.sum(z * F.col(f"__l{k}")), F.lit(0.0)) for k in range(1, nlags + 1)]
    # the mean carries rounding noise: a constant series must count as having no variance
    noise = F.lit(1e-20) * F.first("n") * (1 + F.pow(F.first("__mean"), 2))
    totals = lagged.groupBy(*keys).agg(F.first("n").alias("n"), F.array(*sums).alias("__c"), noise.alias("__noise"))
    r = F.transform(
        F.slice("__c", 1, F.least(F.lit(nlags + 1), F.col("n").cast("int"))),
        lambda c: F.when(F.col("__c")[0] > F.col("__noise"), c / F.nullif(F.col("__c")[0], F.lit(0.0))),
    )
    return totals.select(*keys, "n", r.alias("__r"))


def acf(df: DataFrame, keys: Sequence[str], pos: str, col: str, nlags: int = 24) -> DataFrame:
    """Autocorrelation with Bartlett's 5 % band, lags 0..nlags."""
    curves = _lag_curves(df, keys, pos, col, nlags)
    return _long_curve(curves, keys, "acf", F.col("__r"), bartlett=True)


def pacf(df: DataFrame, keys: Sequence[str], pos: str, col: str, nlags: int = 24) -> DataFrame:
    """Partial autocorrelation (Yule-Walker on the unadjusted acf), band ±1.96/sqrt(n)."""
    curves = _lag_curves(df, keys, pos, col, nlags)
    return _long_curve(curves, keys, "pacf", _pacf_curve("__r"), bartlett=False)


def acf_pacf(df: DataFrame, keys: Sequence[str], pos: str, col: str, nlags: int = 24) -> DataFrame:
    """Both curves with their bands from one pass over the series."""
    curves = _lag_curves(df, keys, pos, col, nlags).withColumn("__p", _pacf_curve("__r"))
    item = F.arrays_zip(F.col("__r").alias("a"), F.col("__p").alias("b"), _bartlett_band().alias("s"))
    rows = curves.select(*keys, "n", F.posexplode(item).alias("lag", "v"))
    flat = Z95 / F.sqrt("n")
    return rows.select(
        *keys, "n", "lag",
        F.col("v.a").alias("acf"), F.col("v.s").alias("acf_band"),
        F.col("v.b").alias("pacf"), F.when(F.col("lag") > 0, flat).otherwise(F.lit(0.0)).alias("pacf_band"),
    )


def _bartlett_band() -> Column:
    """Half width per lag: 0 at lag 0, then Z95*sqrt((1 + 2*sum of earlier r^2)/n)."""

    def half(_: Column, k: Column) -> Column:
        earlier = F.aggregate(F.slice("__r", 2, F.greatest(k - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + r * r)
        return F.when(k == 0, F.lit(0.0)).otherwise(Z95 * F.sqrt((1 + 2 * earlier) / F.col("n")))

    return F.transform("__r", half)


def _long_curve(curves, keys, name, values, *, bartlett):
    band = _bartlett_band() if bartlett else F.transform(
        "__r", lambda _, k: F.when(k == 0, F.lit(0.0)).otherwise(Z95 / F.sqrt(F.col("n")))
    )
    item = F.arrays_zip(values.alias("v"), band.alias("s"))
    rows = curves.withColumn("__item", item).select(*keys, "n", F.posexplode("__item").alias("lag", "e"))
    value, half = F.col("e.v"), F.col("e.s")
    return rows.select(
        *keys,
        "lag",
        value.alias(name),
        (value - half).alias("ci_lo"),
        (value + half).alias("ci_hi"),
        (F.abs(value) > half).alias("significant"),
    )


def order_hint(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Written identification rules applied to `acf_pacf` output.

    The pacf (acf) cuts off at the last significant lag before the first one that is
    not. A positive lag-1 autocorrelation points to AR terms, a negative one to MA.
    """
    lag = F.col("lag")

    def cutoff(value: str, band: str) -> Column:
        quiet = F.min(F.when((lag > 0) & (F.abs(value) <= F.col(band)), lag))
        return (F.coalesce(quiet, F.max(lag) + 1) - 1).cast("int")

    hints = curves.groupBy(*keys).agg(
        cutoff("pacf", "pacf_band").alias("ar_cutoff"),
        cutoff("acf", "acf_band").alias("ma_cutoff"),
        F.max(F.when(lag == 1, F.col("acf"))).alias("acf1"),
    )
    ar = F.col("acf1") >= 0
    return hints.select(
        *keys, "acf1", "ar_cutoff", "ma_cutoff",
        F.when(ar, F.lit("AR")).otherwise(F.lit("MA")).alias("suggest"),
        F.when(ar, F.col("ar_cutoff")).otherwise(F.col("ma_cutoff")).alias("terms"),
    )
