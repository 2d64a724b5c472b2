"""Moments of overlapping folds from shared cells, against plain numpy over each fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebin.operators import backtest
from tidebin.operators.folds import fold_moments, series_spans

LAGS = 2


def fold_table(spark, data, ds, **shape):
    rows = [(s, int(p), None if v is None else float(v)) for s, pairs in data.items() for p, v in pairs]
    df = spark.createDataFrame(rows, "s string, t long, y double")
    designs = backtest._with_designs(df, ["s"], "t", "y", ds, LAGS, [])
    cols = [f"w{i}" for i in range(LAGS + 1)]
    spans = series_spans(df, ["s"], "t")
    return fold_moments(designs, ["s"], "t", cols, [F.col("__y").alias("y")], spans, warm_up=LAGS, **shape)


def by_hand(pairs, d, train, horizon, step):
    """{fold: (n, mean, cov, tests)} with every fold gathered on its own."""
    value = {p: v for p, v in pairs}
    first, span = min(value), max(value) - min(value) + 1
    out = {}
    for f in range((span - train - horizon) // step + 1):
        at = first + f * step
        design = []
        for p in range(at + LAGS + d, at + train):
            levels = [value.get(p - i) for i in range(LAGS + d + 1)]
            if None not in levels:
                design.append(np.diff(levels[::-1], d)[::-1][: LAGS + 1])
        tests = [(train + i, value[p]) for i, p in enumerate(range(at + train, at + train + horizon)) if p in value]
        x = np.array(design).reshape(-1, LAGS + 1)
        out[f] = (len(x), x.mean(axis=0) if len(x) else None, np.cov(x.T, bias=True) if len(x) else None, tests)
    return out


def series_of(kind, n=97):
    rng = np.random.default_rng(3)
    if kind == "walk far from zero":
        return [(p, v) for p, v in enumerate(1e7 + rng.normal(size=n).cumsum())]
    if kind == "step":
        return [(p, v) for p, v in enumerate(rng.normal(size=n) + 1e5 * (np.arange(n) > 50))]
    gone = {0: None, **{p: 1 for p in range(30, 48)}, 60: 1, 61: 1}
    return [(p + 5, v if p != 70 else None) for p, v in enumerate(rng.normal(size=n)) if p not in gone]


@pytest.mark.parametrize("train,horizon,step", [(24, 5, 1), (24, 5, 7), (20, 4, 25), (30, 6, 6), (3, 2, 2)])
@pytest.mark.parametrize("direct", [0, 10_000])
def test_moments_of_every_fold(spark, train, horizon, step, direct):
    data = {kind: series_of(kind) for kind in ("walk far from zero", "step", "gaps")}
    got = fold_table(spark, data, [0, 1, 2], train=train, horizon=horizon, step=step, direct=direct).collect()
    found = {(r.s, r.d, r.fold): r for r in got}
    assert len(found) == len(got)
    for s, pairs in data.items():
        for d in (0, 1, 2):
            want = by_hand(pairs, d, train, horizon, step)
            for f, (n, mean, cov, tests) in want.items():
                r = found.pop((s, d, f), None)
                if r is None:
                    assert n == 0 and not tests
                    continue
                assert r.n == n, (s, d, f)
                assert [(t.fold_row, t.y) for t in r.tests] == tests
                if n:
                    scale = np.abs(np.diagonal(cov)).max() + 1e-300
                    np.testing.assert_allclose(r.mean, mean, rtol=1e-12, atol=1e-12 * max(1.0, scale**0.5))
                    np.testing.assert_allclose(np.reshape(r.cov, cov.shape), cov, atol=1e-8 * scale)
    assert not found


def test_constant_columns_have_no_variance(spark):
    flat = {"flat": [(p, 0.1) for p in range(60)], "line": [(p, 3.0 * p) for p in range(60)]}
    for r in fold_table(spark, flat, [0, 1], train=21, horizon=3, step=4, direct=0).collect():
        if r.s == "flat" or r.d == 1:
            assert r["cov"] == [0.0] * 9


def test_empty_and_short_series(spark):
    shape = dict(train=24, horizon=5, step=3, direct=0)
    assert fold_table(spark, {"short": series_of("step", 28)}, [0], **shape).collect() == []
    assert fold_table(spark, {}, [0], **shape).collect() == []
    assert len(fold_table(spark, {"one": series_of("step", 29)}, [0], **shape).collect()) == 1


def test_a_fold_moves_no_training_row(spark):
    """Rows that reach the windows grow with the series and its steps, not with train / step."""
    data = {"walk": series_of("walk far from zero", 400)}
    for train in (40, 200):
        out = fold_table(spark, data, [0], train=train, horizon=1, step=5, direct=0)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in plan and plan.count("Join") == 1
        assert out.count() == (400 - train - 1) // 5 + 1
