import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebin.operators import association, backtest, cluster, density, importance, ordering, regression
from tidebin.operators.folds import rolling_origin_folds


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 60
    a, b, c = rng.normal(size=(3, n))
    y = 100 + 5 * a - 2 * b + rng.normal(size=n)
    return pd.DataFrame({"bin_idx": np.arange(n), "y": y, "a": a, "b": b + 0.5 * a, "c": c})


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data).cache()


def test_pearson_and_target(table, data):
    cols = ["y", "a", "b", "c"]
    got = association.pearson_matrix(table, cols).toPandas()
    assert len(got) == 10
    want = data[cols].corr()
    assert all(abs(r.r - want.loc[r.x, r.y]) < 1e-10 for r in got.itertuples())
    to_y = {r.variable: r.r for r in association.corr_with_target(table, "y", ["a", "b", "c"]).collect()}
    assert all(abs(to_y[c] - want.loc["y", c]) < 1e-10 for c in to_y)


def test_constant_column_has_no_correlation(table):
    df = table.withColumn("k", F.lit(1.0))
    rows = {(r.x, r.y): r.r for r in association.pearson_matrix(df, ["y", "k"]).collect()}
    assert rows["k", "y"] is None and rows["k", "k"] is None and rows["y", "y"] == 1.0
    assert association.corr_with_target(df, "y", ["k"]).first().r is None


def test_partial_correlation_is_that_of_residuals(table, data):
    got = {r.variable: r.r for r in association.partial_corr(table, "y", ["a", "b", "c"]).collect()}
    for x in "abc":
        others = np.column_stack([np.ones(len(data)), data[[c for c in "abc" if c != x]]])
        res = [v - others @ np.linalg.lstsq(others, v, rcond=None)[0] for v in (data.y.values, data[x].values)]
        assert abs(got[x] - np.corrcoef(*res)[0, 1]) < 1e-9


@pytest.mark.parametrize("count_equal", [False, True])
def test_density(spark, count_equal):
    rng = np.random.default_rng(3)
    values = {"p": rng.integers(0, 20, 200).astype(float), "q": rng.normal(1e6, 2.0, 80)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("one", 1.0)], "k string, v double")
    got = density.kde(df, "v", ["k"], count_equal=count_equal).toPandas()
    assert set(got.k) == {"p", "q"}
    for k, v in values.items():
        g = got[got.k == k].sort_values("grid")
        h = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 200)
        want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        np.testing.assert_allclose(g.x, x, rtol=1e-12)
        np.testing.assert_allclose(g.density, want, rtol=1e-8, atol=1e-14)
        assert abs(np.trapezoid(g.density, g.x) - 1) < 0.01


def test_kmeans_is_the_exact_split(spark):
    rng = np.random.default_rng(9)
    v = np.r_[rng.normal(10, 2, 30), rng.normal(30, 4, 50)]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = cluster.kmeans_1d(df, "v").toPandas()
    s = np.sort(v)
    cost = [((s[:i] - s[:i].mean()) ** 2).sum() + ((s[i:] - s[i:].mean()) ** 2).sum() for i in range(1, len(s))]
    high = set(s[int(np.argmin(cost)) + 1 :])
    assert all((r.cluster == 0) == (r.v in high) for r in got.itertuples())


def fit_numpy(d, x):
    z = np.column_stack([d[x], np.ones(len(d))])
    beta, *_ = np.linalg.lstsq(z, d.y, rcond=None)
    return z, beta


def test_least_squares_inference(table, data):
    x = ["a", "b", "c"]
    fit = regression.ols_fit(table, "y", x)
    got = regression.ols_inference(fit, x).toPandas().set_index("term").loc[[*x, "const"]]
    z, beta = fit_numpy(data, x)
    resid = data.y - z @ beta
    s2 = resid @ resid / (len(data) - 4)
    se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * s2)
    np.testing.assert_allclose(got.coef, beta, atol=1e-9)
    np.testing.assert_allclose(got.se, se, rtol=1e-8)
    np.testing.assert_allclose(got.t, beta / se, rtol=1e-7)
    assert got.p["a"] < 1e-6 < got.p["c"] <= 1
    sst = ((data.y - data.y.mean()) ** 2).sum()
    assert abs(got.r2.iloc[0] - (1 - resid @ resid / sst)) < 1e-10


def test_redundant_and_constant_regressors(table, data):
    df = table.withColumn("twin", F.col("a") * 2).withColumn("flat", F.lit(3.0))
    fit = regression.ols_fit(df, "y", ["a", "twin", "flat"])
    pred = regression.ols_predict(df, fit, ["a", "twin", "flat"]).toPandas().sort_values("bin_idx")
    z, beta = fit_numpy(data, ["a"])
    np.testing.assert_allclose(pred.predicted, z @ beta, atol=1e-6)


@pytest.mark.parametrize("fit_on", ["all", "train"])
@pytest.mark.parametrize("split", ["chronological", "random"])
def test_holdout_errors_in_target_units(table, data, split, fit_on):
    out = regression.fit_holdout(table, "y", ["a", "b"], split=split, seed=5, fit_on=fit_on)
    pred = out.predictions.toPandas().sort_values("bin_idx")
    assert (~pred.is_train).sum() == 12
    if split == "chronological":
        assert pred.is_train.tolist() == [True] * 48 + [False] * 12
    train = data[pred.is_train.values]
    _, beta = fit_numpy(train, ["a", "b"])
    err = np.abs(np.column_stack([data[["a", "b"]], np.ones(60)]) @ beta - data.y)
    got = {r["sample"]: r for r in out.metrics.collect()}
    assert abs(got["in_sample"].mae - err[pred.is_train.values].mean()) < 1e-8
    assert abs(got["out_of_sample"].mae - err[~pred.is_train.values].mean()) < 1e-8


def test_scaling_round_trip(table):
    stats = regression.scale_stats(table, ["a"])
    scaled = regression.minmax_scale(table, ["a"], stats=stats)
    low, high = scaled.agg(F.min("a"), F.max("a")).first()
    assert (low, high) == (0.0, 1.0)
    back = regression.minmax_inverse(scaled, "a", "a", stats).join(table.select("bin_idx", F.col("a").alias("was")), "bin_idx")
    assert back.filter("abs(a - was) > 1e-12").count() == 0


def test_random_index_is_a_permutation_and_repeatable(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    a = ordering.with_random_index(df.repartition(7), ["id"], 1, ["k"]).toPandas().sort_values("id")
    b = ordering.with_random_index(df.repartition(2), ["id"], 1, ["k"]).toPandas().sort_values("id")
    assert a.shuffled.tolist() == b.shuffled.tolist()
    for _, g in a.groupby("k"):
        assert sorted(g.shuffled) == list(range(len(g)))


def test_importances_find_the_driver(table):
    model = importance.fit_forest(table, "y", ["a", "b", "c"], trees=20, depth=8)
    imp = {r.feature: r.importance for r in importance.impurity_importance(model, ["a", "b", "c"], table).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and max(imp, key=imp.get) == "a"
    perm = importance.permutation_importance(model, table, "y", ["a", "b", "c"], ["bin_idx"]).collect()
    drops = {r.feature: r.importance for r in perm}
    assert {r.repeats for r in perm} == {5} and max(drops, key=drops.get) == "a" and drops["c"] < 0.1


def ar_forecast(y, x, p, d, pmax, future_x):
    """Fit on the array, forecast with plain loops."""
    w, wx = np.diff(y, d), np.diff(x, d, axis=0)
    t = np.arange(pmax, len(w))
    z = np.column_stack([wx[t], *[w[t - i] for i in range(1, p + 1)], np.ones(len(t))])
    beta, *_ = np.linalg.lstsq(z, w[t], rcond=None)
    m, hist, levels = x.shape[1], list(w), list(y)
    allx = np.diff(np.vstack([x, future_x]), d, axis=0)[-len(future_x):]
    for row in allx:
        step = beta[:m] @ row + sum(beta[m + i] * hist[-1 - i] for i in range(p)) + beta[-1]
        hist.append(step)
        levels.append(step if d == 0 else levels[-1] + step if d == 1 else 2 * levels[-1] - levels[-2] + step)
    return np.array(levels[len(y):])


def test_backtest_grid_against_loops(table, data):
    df = table.withColumn("k", F.lit("s"))
    orders = [(p, d) for p in range(3) for d in range(3)]
    sets = {"none": [], "ab": ["a", "b"]}
    folds = backtest.backtest_folds(
        df, ["k"], "bin_idx", "y", orders=orders, train=30, horizon=5, step=10, exog_sets=sets
    ).cache()
    assert folds.count() == 3 * len(orders) * len(sets)
    for r in folds.collect():
        at = r.fold * 10
        x = data[list(sets[r.exog_set])].values.reshape(60, -1)
        want = ar_forecast(data.y.values[at : at + 30], x[at : at + 30], r.p, r.d, 2, x[at + 30 : at + 35])
        assert abs(np.abs(want - data.y.values[at + 30 : at + 35]).mean() - r.mae) < 1e-6
    grid = backtest.backtest_grid(folds, ["k"])
    best = grid.filter("rank = 1 and exog_set = 'none'").first()
    assert best.mae == pytest.approx(grid.filter("exog_set = 'none'").agg(F.min("mae")).first()[0])
    gains = {r.exog_set: r.gain for r in backtest.funnel_comparison(grid, ["k"]).collect()}
    assert gains["none"] == 0 and gains["ab"] > 0


@pytest.mark.parametrize("order", [(0, 0), (2, 0), (1, 1), (2, 2)])
def test_forecast_against_loops(table, data, order):
    got = backtest.forecast(table, [], "bin_idx", "y", horizon=12, order=order).orderBy("step_ahead").toPandas()
    none = np.zeros((60, 0))
    want = ar_forecast(data.y.values, none, *order, order[0], np.zeros((12, 0)))
    np.testing.assert_allclose(got.forecast, want, rtol=1e-7)
    assert got.bin_idx.tolist() == list(range(60, 72))


def test_folds_cover_whole_windows(table):
    out = rolling_origin_folds(table, [], "bin_idx", train=20, horizon=10, step=15).toPandas()
    assert sorted(out.fold.unique()) == [0, 1, 2]
    for f, g in out.groupby("fold"):
        g = g.sort_values("bin_idx")
        assert g.bin_idx.tolist() == list(range(15 * f, 15 * f + 30))
        assert g.role.tolist() == ["train"] * 20 + ["test"] * 10


def test_many_pvalues_at_once():
    from tidebin.functions.special import student_t_pvalue, student_t_pvalues

    t = np.array([0.0, 0.3, -1.5, 2.228, 40.0, np.inf, np.nan, 1.96, 1e-9])
    df = np.array([3.0, 1.0, 7.0, 10.0, 5.0, 3.0, 3.0, 1e6, 2.0])
    want = [student_t_pvalue(a, b) for a, b in zip(t, df)]
    assert np.allclose(student_t_pvalues(t, df), want, rtol=1e-12, equal_nan=True)
