import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebin.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_equals_percentile(spark, accuracy):
    """Ties, one hot group, equal values, extreme and missing values."""
    rnd = random.Random(2)
    rows = [("hot", rnd.lognormvariate(0, 3)) for _ in range(9000)]
    rows += [("tie", float(rnd.randrange(4))) for _ in range(1000)] + [("same", 2.5)] * 500
    rows += [("two", 1.0), ("two", 4.0), ("one", -7.0), ("none", None), ("odd", float("inf")), ("odd", -1e300), ("odd", 0.0), ("odd", float("nan")), ("odd", None)]
    rows += [(None, float(x)) for x in range(17)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {(r.k, r.share): r.quantile for r in exact_quantiles(df, "v", SHARES, ["k"], accuracy=accuracy).collect()}
    want = {(r.k, s): x for r in df.groupBy("k").agg(F.percentile("v", SHARES).alias("q")).collect() for s, x in zip(SHARES, r.q or [None] * len(SHARES))}
    assert got.keys() == want.keys()
    for key, x in want.items():
        assert got[key] == x or got[key] == pytest.approx(x, rel=1e-12, nan_ok=True), key


def test_without_keys_and_empty(spark):
    df = spark.range(101).select(F.col("id").alias("v"))
    assert [r.quantile for r in exact_quantiles(df, "v", [0.5, 0.9]).orderBy("share").collect()] == [50.0, 90.0]
    assert [r.quantile for r in exact_quantiles(df.filter("v < 0"), "v", [0.5]).collect()] == [None]
    assert exact_quantiles(df.filter("v < 0"), "v", [0.5], ["v"]).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(df, "v", [1.5])


def test_rows_are_not_gathered_by_a_large_group(spark):
    df = spark.range(20_000).selectExpr("if(id % 50 = 0, 'few', 'many') as k", "cast(id * 7919 % 20011 as double) as v")
    out = exact_quantiles(df, "v", [0.5], ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") <= 1  # that of the results, one row for each group and share
    rows = df.collect()
    assert {r.k: r.quantile for r in out.collect()} == {k: float(np.quantile([r.v for r in rows if r.k == k], 0.5)) for k in ("few", "many")}


def test_tasks_in_proportion_to_rows(spark, monkeypatch):
    """Twice the rows, twice the tasks, and the same filled series."""
    from tidebin import session
    from tidebin.operators.fill import interpolate_linear

    df = session.settle(spark.range(4000).selectExpr("id % 40 as k", "id div 40 as pos", "if(id % 7 = 0, cast(id as double), null) as v"))
    whole = {(r.k, r.pos): r.v for r in interpolate_linear(df, ["k"], "pos", "v").collect()}
    monkeypatch.setattr(session, "TASK_ROWS", 400)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert [session.spread(df, n, "k").rdd.getNumPartitions() for n in (4000, 8000)] == [10, 20]
        out = interpolate_linear(df, ["k"], "pos", "v")
        assert out.rdd.getNumPartitions() == 10 and {(r.k, r.pos): r.v for r in out.collect()} == whole
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
