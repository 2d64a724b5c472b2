"""Many series solved in stacks give what each gives alone, whatever else is in the stack."""

import numpy as np
import pytest

from tidebin.operators import association, stationarity


def mixed():
    rng = np.random.default_rng(12)
    data = {f"walk{i}": rng.normal(size=20 + 9 * i).cumsum() for i in range(6)}
    data |= {"noise": rng.normal(size=74), "flat": np.full(40, 3.0), "line": np.arange(40.0), "short": rng.normal(size=5)}
    data["pulse"] = np.r_[np.zeros(20), 1.0, np.zeros(19)]
    return data


@pytest.mark.parametrize("test", [stationarity.adf_test, stationarity.adf_trend_test])
def test_unit_roots(spark, test):
    data = mixed()
    frame = lambda some: spark.createDataFrame([(s, t, float(v)) for s in some for t, v in enumerate(data[s])], "s string, t long, y double")
    together = {r.s: r for r in test(frame(data), ["s"], "t", "y").collect()}
    assert set(together) == set(data)
    for s in ("walk0", "walk5", "noise", "flat", "line", "pulse", "short"):
        alone = test(frame([s]), ["s"], "t", "y").collect()[0]
        for name, value in alone.asDict().items():
            assert together[s][name] == (value if value is None or isinstance(value, str) else pytest.approx(value, rel=1e-9)), (s, name)
    assert together["flat"]["stat"] is None and together["noise"]["pvalue"] <= 0.02


def test_partial_correlations(spark):
    rng = np.random.default_rng(2)
    rows = [(k, *map(float, rng.normal(size=3))) for k in "abc" for _ in range(30)]
    rows += [("flat", 1.0, float(i), float(i * i % 7)) for i in range(9)] + [("few", 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")
    got = {(r.k, r.variable): r.r for r in association.partial_corr(df, "x", ["y", "z"], ["k"]).collect()}
    for k in "abc":
        inverse = np.linalg.inv(np.corrcoef(np.array([r[1:] for r in rows if r[0] == k]).T))
        assert got[k, "y"] == pytest.approx(-inverse[0, 1] / np.sqrt(inverse[0, 0] * inverse[1, 1]))
    assert {got[k, v] for k in ("flat", "few") for v in "yz"} == {None}
    assert association.partial_corr(df.limit(0), "x", ["y", "z"], ["k"]).collect() == []
