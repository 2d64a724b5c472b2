"""Series operators against plain numpy and pandas, with blocks far shorter than the series."""

import numpy as np
import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebin.functions.special import adf_critical, adf_pvalue, student_t_pvalue, trend_pvalue
from tidebin.operators import bins, common, fill, signal, stationarity


def walk(n, seed, drift=0.0):
    return np.cumsum(np.random.default_rng(seed).normal(drift, 1.0, n)) + 50


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    ar = np.zeros(150)
    for t in range(1, 150):
        ar[t] = 0.5 * ar[t - 1] + rng.normal()
    return {
        "walk": walk(130, 1),
        "trend": walk(90, 2, 0.4),
        "stationary": ar,
        "twice": np.cumsum(walk(101, 3) - 50),
    }


@pytest.fixture(scope="module")
def table(spark, series):
    # positions need not start at zero
    frames = [pd.DataFrame({"k": k, "pos": np.arange(len(y)) + 7, "y": y}) for k, y in series.items()]
    return spark.createDataFrame(pd.concat(frames), "k string, pos long, y double").cache()


def per_key(df, key="k"):
    return {k: g.sort_values([c for c in ("pos", "lag") if c in g.columns]) for k, g in df.toPandas().groupby(key)}


@pytest.mark.parametrize("size", [5, 13, 4096])
def test_lags_and_leads_cross_blocks(table, size):
    w = Window.partitionBy("k").orderBy("pos")
    want = table.withColumns({"a": F.lag("y", 3).over(w), "b": F.lead("y", 2).over(w)})
    got = common.with_lags(table, ["k"], "pos", {"a": ("y", 3), "b": ("y", -2)}, size)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("order", [1, 2])
def test_differences(table, series, order):
    got = per_key(signal.difference(table, ["k"], "pos", "y", order))
    for k, y in series.items():
        np.testing.assert_allclose(got[k].y, np.diff(y, order), atol=1e-12)


@pytest.mark.parametrize("period", [12, 7])
def test_decomposition(table, series, period):
    got = per_key(signal.decompose_additive(table, ["k"], "pos", "y", period))
    for k, y in series.items():
        weights = np.r_[0.5, np.ones(period - 1), 0.5] / period if period % 2 == 0 else np.ones(period) / period
        half = period // 2
        trend = np.full(len(y), np.nan)
        trend[half : len(y) - half] = np.convolve(y, weights, "valid")
        phase = np.arange(len(y)) % period
        means = np.array([np.nanmean((y - trend)[phase == p]) for p in range(period)])
        seasonal = (means - means.mean())[phase]
        np.testing.assert_allclose(got[k].trend, trend, atol=1e-9)
        np.testing.assert_allclose(got[k].seasonal, seasonal, atol=1e-9)
        np.testing.assert_allclose(got[k].resid, y - trend - seasonal, atol=1e-9)
        assert abs(got[k].seasonal.head(period).sum()) < 1e-9


def acf_of(y, nlags):
    z = y - y.mean()
    return np.array([(z[k:] * z[: len(z) - k]).sum() for k in range(nlags + 1)]) / (z * z).sum()


def test_autocorrelation_curves(table, series):
    got = per_key(signal.acf_pacf(table, ["k"], "pos", "y", 10))
    for k, y in series.items():
        r = acf_of(y, 10)
        np.testing.assert_allclose(got[k].acf, r, atol=1e-10)
        for p in range(1, 11):  # Yule-Walker system solved outright
            toeplitz = r[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))]
            assert abs(got[k].pacf.iloc[p] - np.linalg.solve(toeplitz, r[1 : p + 1])[-1]) < 1e-8
        band = [0] + [1.959963984540054 * np.sqrt((1 + 2 * (r[1:j] ** 2).sum()) / len(y)) for j in range(1, 11)]
        np.testing.assert_allclose(got[k].acf_band, band, atol=1e-10)


def test_constant_and_short_series(spark):
    df = spark.createDataFrame([("c", i, 0.1) for i in range(30)] + [("s", 0, 1.0), ("s", 1, 2.0)], "k string, pos long, y double")
    got = per_key(signal.acf(df, ["k"], "pos", "y", 5))
    assert got["c"].acf.isna().all() and len(got["s"]) == 2
    tests = {r.k: r for r in stationarity.adf_test(df, ["k"], "pos", "y").collect()}
    assert tests["c"].stat is None and tests["s"].stat is None
    assert {r.k: r.d for r in stationarity.ndiffs(df, ["k"], "pos", "y").collect()} == {"c": 0, "s": 0}


def test_gaps_inside_a_series(spark):
    y = walk(40, 8)
    rows = [("g", i, None if i == 20 else float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, pos long, y double")
    got = per_key(signal.acf(df, ["k"], "pos", "y", 3))["g"]
    z = np.where(np.arange(40) == 20, np.nan, y)
    z = z - np.nanmean(z)
    want = [np.nansum(z[k:] * z[: 40 - k]) / np.nansum(z * z) for k in range(4)]
    np.testing.assert_allclose(got.acf, want, atol=1e-10)
    with pytest.raises((PySparkException, Py4JJavaError), match="gaps"):
        stationarity.adf_test(df, ["k"], "pos", "y").collect()


def ols(y, x):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    return beta, float(resid @ resid), np.linalg.inv(x.T @ x)


def adf_rows(x, lags, start, trend=False):
    d = np.diff(x)
    t = np.arange(start, len(x))
    cols = [x[t - 1], *[d[t - 1 - k] for k in range(1, lags + 1)], np.ones(len(t))]
    return d[t - 1], np.column_stack(cols + ([t.astype(float)] if trend else []))


def adf_brute(x):
    n = len(x)
    maxlag = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    aics = []
    for lag in range(maxlag + 1):
        y, z = adf_rows(x, lag, maxlag + 1)
        ssr = ols(y, z)[1]
        aics.append(len(y) * (np.log(2 * np.pi) + np.log(ssr / len(y)) + 1) + 2 * z.shape[1])
    lag = int(np.argmin(aics))
    y, z = adf_rows(x, lag, lag + 1)
    beta, ssr, inv = ols(y, z)
    return beta[0] / np.sqrt(ssr / (len(y) - z.shape[1]) * inv[0, 0]), lag, len(y)


def test_adf_against_brute_force(table, series):
    got = {r.k: r for r in stationarity.adf_test(table, ["k"], "pos", "y").collect()}
    for k, y in series.items():
        stat, lag, nobs = adf_brute(y)
        assert (got[k].usedlag, got[k].nobs) == (lag, nobs)
        assert abs(got[k].stat - stat) < 1e-6 and abs(got[k].pvalue - adf_pvalue(stat)) < 1e-6
        assert abs(got[k].crit_5 - adf_critical(nobs)["5%"]) < 1e-12


def test_block_size_does_not_matter(table):
    lags = F.lit(4)
    whole = stationarity.lag_grams(table, ["k"], "pos", "y", lags, trend=True).toPandas().set_index("k")
    small = stationarity.lag_grams(table, ["k"], "pos", "y", lags, trend=True, size=9).toPandas().set_index("k")
    for k in whole.index:
        np.testing.assert_allclose(whole.gram[k], small.gram[k], rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(whole["head"][k], small["head"][k])


def test_ndiffs_against_brute_force(table, series):
    got = {(r.k, r.alpha): r.d for r in stationarity.ndiffs(table, ["k"], "pos", "y", alphas=(0.05, 0.025)).collect()}
    for k, y in series.items():
        for alpha in (0.05, 0.025):
            d, x = 0, y
            while d < 2:
                lags = int(np.trunc(round((len(x) - 1) ** (1 / 3), 9)))
                rhs, z = adf_rows(x, lags, lags + 1, trend=True)
                beta, ssr, inv = ols(rhs, z)
                stat = beta[0] / np.sqrt(ssr / (len(rhs) - z.shape[1]) * inv[0, 0])
                if trend_pvalue(stat, len(x) - 1) <= alpha:
                    break
                d, x = d + 1, np.diff(x)
            assert got[k, alpha] == d
    chosen = per_key(stationarity.stationary_signal(table, ["k"], "pos", "y"))
    for k, y in series.items():
        np.testing.assert_allclose(chosen[k].y, np.diff(y, got[k, 0.05]), atol=1e-10)


def test_published_points():
    assert abs(adf_pvalue(-2.86) - 0.05) < 2e-3
    assert abs(adf_critical(1e9)["1%"] + 3.43035) < 1e-6
    assert abs(trend_pvalue(-3.45, 100) - 0.05) < 1e-12 and trend_pvalue(-9, 100) == 0.01
    # t quantiles from standard tables
    assert abs(student_t_pvalue(2.228, 10) - 0.05) < 1e-4 and abs(student_t_pvalue(12.706, 1) - 0.05) < 1e-4
    assert abs(student_t_pvalue(1.96, 1e6) - 0.05) < 1e-4


@pytest.mark.parametrize("size", [2, 3, 4096])
def test_interpolation_matches_pandas(spark, size):
    cases = {
        "edges": [None, 1.0, None, None, 4.0, None],
        "full": [3.0, 1.0, 2.0],
        "empty": [None, None, None],
        "late": [None] * 9 + [5.0] + [None] * 8 + [8.0, None],
    }
    rows = [(k, i, v) for k, values in cases.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, pos long, y double")
    got = per_key(fill.interpolate_linear(df, ["k"], "pos", "y", size))
    for k, values in cases.items():
        want = pd.Series(values, dtype=float).interpolate("linear").ffill().bfill()
        np.testing.assert_allclose(got[k].y.astype(float), want)


def test_gap_fill_keeps_series_apart(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 3, 2), ("b", 5, 3)], "k string, bin_idx long, v long")
    out = bins.gap_fill(df, ["k"], zero=["v"]).orderBy("k", "bin_idx").collect()
    assert [(r.k, r.bin_idx, r.v) for r in out] == [("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 2), ("b", 5, 3)]
