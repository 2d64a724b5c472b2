"""Rolling-origin evaluation and forecasting of autoregressions fitted by least squares.

A model of order (p, d) regresses the d-times differenced series on its own p lags and,
optionally, on equally differenced exogenous columns. The
moments of a fold come from `folds`; every order and every exogenous set is solved from them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebin.operators.common import attach, with_lags
from tidebin.operators.folds import fold_moments, series_spans
from tidebin.operators.moments import moment_columns
from tidebin.operators.regression import solve, stacked
from tidebin.operators.signal import difference_of


def _with_designs(df, keys, pos, y, ds, pmax, exog):
    """Per row the level history, then one row per d: target w, its lags and exogenous values."""
    dmax = max(ds)
    lags = {f"__l{k}": ("__y", k) for k in range(1, pmax + dmax + 1)}
    lags |= {f"__x{j}_l{k}": (f"__x{j}", k) for j in range(len(exog)) for k in range(1, dmax + 1)}
    base = df.select(
        *keys, pos, F.col(y).cast("double").alias("__y"),
        *[F.col(c).cast("double").alias(f"__x{j}") for j, c in enumerate(exog)],
    )
    rows = with_lags(base, keys, pos, lags)
    level = [F.col("__y"), *[F.col(f"__l{k}") for k in range(1, pmax + dmax + 1)]]
    rows = rows.withColumn("__levels", F.array(*level))

    def design(d: int) -> Column:
        w = [difference_of(level[i : i + d + 1], d).alias(f"w{i}") for i in range(pmax + 1)]
        x = []
        for j in range(len(exog)):
            series = [F.col(f"__x{j}"), *[F.col(f"__x{j}_l{k}") for k in range(1, dmax + 1)]]
            x.append(difference_of(series[: d + 1], d).alias(f"x{j}"))
        return F.struct(F.lit(d).alias("d"), *w, *x)

    return rows.withColumn("__designs", F.array(*[design(d) for d in ds])).select(
        *keys, pos, "__y", "__levels", "__designs"
    )


def _sub_model(mean: np.ndarray, cov: np.ndarray, xs: Sequence[int], p: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Moments of target, chosen exogenous columns and the first p lags, for a stack of systems."""
    pick = [0, *[1 + j for j in xs], *[1 + m + i for i in range(p)]]
    return mean[:, pick], cov[:, pick][:, :, pick]


def _recurse(levels: np.ndarray, d: int, slopes: np.ndarray, const: np.ndarray, p: int, x: np.ndarray) -> np.ndarray:
    """Forecast many series as many steps as `x` (series, steps, columns) has. `levels` holds
    the last values of each, newest first."""
    k = x.shape[2]
    past = [*levels[:, : p + d + 1][:, ::-1].T]
    diffs = [*(np.diff(np.array(past), d, axis=0) if d else past)]
    out = []
    for step in range(x.shape[1]):
        w = const + np.einsum("mj,mj->m", x[:, step], slopes[:, :k])
        for i in range(p):
            w = w + slopes[:, k + i] * diffs[-1 - i]
        diffs.append(w)
        value = w if d == 0 else past[-1] + w if d == 1 else 2 * past[-1] - past[-2] + w
        past.append(value)
        out.append(value)
    return np.column_stack(out) if out else np.empty((len(levels), 0))


_SCORES = T.ArrayType(
    T.StructType(
        [
            T.StructField("exog_set", T.StringType()),
            T.StructField("p", T.IntegerType()),
            T.StructField("mae", T.DoubleType()),
        ]
    )
)


def _scorer(orders: Sequence[tuple[int, int]], sets: Mapping[str, Sequence[int]], m: int, horizon: int):
    @F.pandas_udf(_SCORES)
    def score(
        d: pd.Series, n: pd.Series, mean: pd.Series, cov: pd.Series, levels: pd.Series, actual: pd.Series, x: pd.Series
    ) -> pd.Series:
        out = [[(name, p, None) for p, order_d in orders if order_d == dd for name in sets] for dd in d]
        ready = [
            i for i, (size, mu, lv, y) in enumerate(zip(n, mean, levels, actual))
            if size > 0 and len(y) == horizon and lv is not None and not any(v is None for v in mu)
        ]
        for dd in sorted({d.iloc[i] for i in ready}):
            where = np.array([i for i in ready if d.iloc[i] == dd], dtype=int)
            mu, c = stacked(mean, cov, where)
            size = n.to_numpy()[where].astype(float)
            lv = np.array([np.asarray(levels.iloc[i], dtype=float) for i in where])
            y = np.array([np.asarray(actual.iloc[i], dtype=float) for i in where])
            future = np.array([np.asarray(x.iloc[i], dtype=float) for i in where]).reshape(len(where), horizon, m)
            cell = 0
            for p in [p for p, order_d in orders if order_d == dd]:
                for name, cols in sets.items():
                    fits = np.flatnonzero(size > p + len(cols) + 1)
                    if len(fits):
                        slopes, const, _, _ = solve(size[fits], *_sub_model(mu[fits], c[fits], cols, p, m))
                        path = _recurse(lv[fits], int(dd), slopes, const, p, future[fits][:, :, list(cols)])
                        err = np.abs(path - y[fits])
                        for j, e in zip(fits, err):
                            out[where[j]][cell] = (name, p, float(e.mean()) if np.isfinite(e).all() else None)
                    cell += 1
        return pd.Series(out)

    return score


def backtest_folds(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    y: str,
    *,
    orders: Sequence[tuple[int, int]],
    train: int,
    horizon: int,
    step: int,
    exog_sets: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Mean absolute error of the multi-step forecast per fold, order and exogenous set.

    Orders with the same d are fitted on the same training rows, so they compare fairly.
    Exogenous values of the test rows are taken as known. In a series with gaps a fold
    trains on the rows whose lags are all there; its error is null if a row of its test
    part or of the levels before it is missing.
    """
    sets = exog_sets or {"none": []}
    exog = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    positions = {name: [exog.index(c) for c in cols] for name, cols in sets.items()}
    ds = sorted({d for _, d in orders})
    pmax = max(p for p, _ in orders)
    rows = _with_designs(df, keys, pos, y, ds, pmax, exog)
    x = F.array(*[F.col(f"x{j}") for j in range(len(exog))]).cast("array<double>").alias("x")
    design_cols = ["w0", *[f"x{j}" for j in range(len(exog))], *[f"w{i}" for i in range(1, pmax + 1)]]
    sums = fold_moments(
        rows, keys, pos, design_cols, [F.col("__y").alias("y"), x], series_spans(df, keys, pos),
        warm_up=pmax, train=train, horizon=horizon, step=step,
    )
    score = _scorer(orders, positions, len(exog), horizon)(
        "d", "n", "mean", "cov", "levels", F.col("tests")["y"], F.flatten(F.col("tests")["x"])
    )
    cells = sums.select(*keys, "fold", "d", F.explode(score).alias("s"))
    return cells.select(*keys, "fold", "s.exog_set", "s.p", "d", "s.mae")


_ARMA = T.ArrayType(
    T.StructType([T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("mae", T.DoubleType())])
)


def _residual_forms(slopes: np.ndarray, const: np.ndarray, q: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """The residuals 1..q positions back of a long autoregression, as weights on the lags
    1.. of the series and a constant, for a stack of series."""
    m = slopes.shape[1]
    weights = np.zeros((len(slopes), q, lags))
    for j in range(q):
        weights[:, j, j] = 1.0
        weights[:, j, j + 1 : j + 1 + m] -= slopes
    return weights, np.broadcast_to(-const[:, None], (len(const), q))


def arma_fit(n: np.ndarray, mean: np.ndarray, cov: np.ndarray, p: int, q: int, long: int):
    """Two-stage least squares (Hannan and Rissanen) from the moments of a series and its lags.

    The first stage regresses the series on `long` lags; its residuals are linear in the
    lags, so the moments of the second stage, on p lags and q residuals, follow from the
    same moments. Returns the slopes (lags, then residuals), the constant, and the weights and
    constants that give the residuals.
    """
    lags = mean.shape[1] - 1
    first = [0, *range(1, long + 1)]
    slopes, const, _, _ = solve(n, mean[:, first], cov[:, first][:, :, first])
    weights, shift = _residual_forms(slopes, const, q, lags)
    form = np.zeros((len(n), 1 + p + q, 1 + lags))
    form[:, range(1 + p), range(1 + p)] = 1.0
    form[:, 1 + p :, 1:] = weights
    mean2 = np.einsum("mij,mj->mi", form, mean)
    mean2[:, 1 + p :] += shift
    cov2 = np.einsum("mij,mjk,mlk->mil", form, cov, form)
    slopes2, const2, _, _ = solve(n, mean2, cov2)
    return slopes2, const2, weights, shift


def _arma_paths(levels: np.ndarray, d: int, p: int, q: int, fit, horizon: int) -> np.ndarray:
    """Forecasts from the last levels, newest first; residuals to come are 0."""
    slopes, const, weights, shift = fit
    past = [*levels[:, ::-1].T]
    diffs = [*(np.diff(np.array(past), d, axis=0) if d else past)]
    lags = weights.shape[2]
    recent = np.stack([diffs[-1 - i] for i in range(lags)], axis=1)
    known = [*(np.einsum("mqj,mj->mq", weights, recent) + shift).T][::-1]
    out = []
    for _ in range(horizon):
        w = const.copy()
        for i in range(p):
            w = w + slopes[:, i] * diffs[-1 - i]
        for j in range(q):
            w = w + slopes[:, p + j] * known[-1 - j]
        diffs.append(w)
        known.append(np.zeros_like(w))
        value = w if d == 0 else past[-1] + w if d == 1 else 2 * past[-1] - past[-2] + w
        past.append(value)
        out.append(value)
    return np.column_stack(out)


def _arma_scorer(orders: Sequence[tuple[int, int, int]], long: int, horizon: int):
    @F.pandas_udf(_ARMA)
    def score(d: pd.Series, n: pd.Series, mean: pd.Series, cov: pd.Series, levels: pd.Series, actual: pd.Series) -> pd.Series:
        of_d = {dd: [(p, q) for p, od, q in orders if od == dd] for dd in set(d)}
        out = [[(p, q, None) for p, q in of_d[dd]] for dd in d]
        ready = [
            i for i, (size, mu, lv, y) in enumerate(zip(n, mean, levels, actual))
            if size > len(mu) and len(y) == horizon and lv is not None and not any(v is None for v in mu)
        ]
        for dd in sorted({d.iloc[i] for i in ready}):
            where = np.array([i for i in ready if d.iloc[i] == dd], dtype=int)
            mu, c = stacked(mean, cov, where)
            size = n.to_numpy()[where].astype(float)
            lv = np.array([np.asarray(levels.iloc[i], dtype=float) for i in where])
            y = np.array([np.asarray(actual.iloc[i], dtype=float) for i in where])
            for cell, (p, q) in enumerate(of_d[dd]):
                path = _arma_paths(lv, int(dd), p, q, arma_fit(size, mu, c, p, q, long), horizon)
                for i, e in zip(where, np.abs(path - y)):
                    out[i][cell] = (p, q, float(e.mean()) if np.isfinite(e).all() else None)
        return pd.Series(out)

    return score


def backtest_arma(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    y: str,
    *,
    orders: Sequence[tuple[int, int, int]],
    train: int,
    horizon: int,
    step: int,
    long: int,
) -> DataFrame:
    """Mean absolute error of the multi-step forecast per fold and order (p, d, q).

    Models with moving-average terms are fitted by two-stage least squares over an
    autoregression of `long` lags. For each fold and d there are the moments of
    the differenced series and its lags; both stages of every order are solved from them, so
    residuals are never materialised. All orders of one d use the same training rows, those
    with `max(p, long + q)` lags in the fold. Gaps are treated as in `backtest_folds`.
    """
    ds = sorted({d for _, d, _ in orders})
    lags = max(max(p for p, _, _ in orders), long + max(q for _, _, q in orders))
    rows = _with_designs(df, keys, pos, y, ds, lags, [])
    sums = fold_moments(
        rows, keys, pos, [f"w{i}" for i in range(lags + 1)], [F.col("__y").alias("y")], series_spans(df, keys, pos),
        warm_up=lags, train=train, horizon=horizon, step=step,
    )
    score = _arma_scorer(orders, long, horizon)("d", "n", "mean", "cov", "levels", F.col("tests")["y"])
    return sums.select(*keys, "fold", "d", F.explode(score).alias("__s")).select(*keys, "fold", "__s.p", "d", "__s.q", "__s.mae")


def arma_grid(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average error over folds of each (p, d, q), with `rank` 1 for the best per series."""
    mean = folds.groupBy(*keys, "p", "d", "q").agg(F.avg("mae").alias("mae"), F.count("mae").alias("folds"))
    best = Window.partitionBy(*keys).orderBy(F.col("mae").asc_nulls_last(), "d", F.col("p") + F.col("q"), "p")
    return mean.withColumn("rank", F.row_number().over(best))


def backtest_grid(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average error over folds, with `rank` 1 for the best order per series and exogenous set."""
    by = [*keys, "exog_set"]
    mean = folds.groupBy(*by, "p", "d").agg(F.avg("mae").alias("mae"), F.count("mae").alias("folds"))
    # one row per candidate order in each window group
    best = Window.partitionBy(*by).orderBy(F.col("mae").asc_nulls_last(), "d", "p")
    return mean.withColumn("rank", F.row_number().over(best))


def funnel_comparison(grid: DataFrame, keys: Sequence[str], baseline: str = "none") -> DataFrame:
    """Best error of each exogenous set and its gain over the set without any."""
    best = grid.filter("rank = 1").select(*keys, "exog_set", "p", "d", "mae")
    base = best.filter(F.col("exog_set") == baseline).select(*keys, F.col("mae").alias("baseline_mae"))
    return attach(best, base, keys).withColumn("gain", F.col("baseline_mae") - F.col("mae"))


def _forecaster(horizon: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(d: pd.Series, p: pd.Series, n: pd.Series, mean: pd.Series, cov: pd.Series, levels: pd.Series) -> pd.Series:
        out: list = [None] * len(n)
        ready = [i for i, (size, pp, mu) in enumerate(zip(n, p, mean)) if size > pp + 1 and not any(v is None for v in mu)]
        for dd, pp in sorted({(d.iloc[i], p.iloc[i]) for i in ready}):
            where = np.array([i for i in ready if d.iloc[i] == dd and p.iloc[i] == pp], dtype=int)
            mu, c = stacked(mean, cov, where)
            lv = np.array([np.asarray(levels.iloc[i], dtype=float) for i in where])
            slopes, const, _, _ = solve(n.to_numpy()[where].astype(float), *_sub_model(mu, c, [], int(pp), 0))
            paths = _recurse(lv, int(dd), slopes, const, int(pp), np.zeros((len(where), horizon, 0)))
            for i, path in zip(where, paths):
                out[i] = path.tolist()
        return pd.Series(out)

    return project


def forecast(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    y: str,
    *,
    horizon: int = 12,
    order: tuple[int, int] | None = None,
    chosen: DataFrame | None = None,
    max_order: tuple[int, int] = (3, 2),
) -> DataFrame:
    """Project each series `horizon` positions ahead: `(keys, step_ahead, pos, forecast)`.

    The order is one (p, d) for all series, or a table `chosen` of `(keys, p, d)` whose
    entries must not exceed `max_order`.
    """
    if (order is None) == (chosen is None):
        raise ValueError("give either one order or a table of chosen orders")
    pmax, ds = (order[0], [order[1]]) if order else (max_order[0], list(range(max_order[1] + 1)))
    rows = _with_designs(df, keys, pos, y, ds, pmax, [])
    wide = rows.select(*keys, F.col(pos).alias("__pos"), "__levels", F.inline("__designs"))
    if order:
        wide = wide.withColumn("p", F.lit(order[0]))
    else:
        wide = attach(wide, chosen.select(*keys, "p", F.col("d").alias("__d")), keys).filter("d = __d")
    sums = wide.groupBy(*keys, "d", "p").agg(
        *moment_columns([F.col(f"w{i}") for i in range(pmax + 1)]),
        F.max_by("__levels", "__pos").alias("levels"),
        F.max("__pos").alias("__last"),
    )
    path = _forecaster(horizon)("d", "p", "n", "mean", "cov", "levels")
    return sums.select(*keys, "__last", F.posexplode(path).alias("i", "forecast")).select(
        *keys, (F.col("i") + 1).alias("step_ahead"), (F.col("__last") + F.col("i") + 1).alias(pos), "forecast"
    )
