"""Moving-average terms, exact shares and filled streams against plain Python."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest

from tidebin.operators import backtest, regression
from tidebin.streaming import intervals


def two_stage(y, d, p, q, long, lags, horizon):
    """Hannan-Rissanen with materialised residuals: the forecast after the last value."""
    w = np.diff(y, d)
    rows = np.arange(lags, len(w))
    x1 = np.column_stack([np.ones(len(rows))] + [w[rows - i] for i in range(1, long + 1)])
    b1 = np.linalg.lstsq(x1, w[rows], rcond=None)[0]
    e = np.full(len(w), np.nan)
    for t in range(long, len(w)):
        e[t] = w[t] - b1[0] - sum(b1[i] * w[t - i] for i in range(1, long + 1))
    x2 = np.column_stack([np.ones(len(rows))] + [w[rows - i] for i in range(1, p + 1)] + [e[rows - j] for j in range(1, q + 1)])
    b2 = np.linalg.lstsq(x2, w[rows], rcond=None)[0]
    w, e, past = list(w), list(e), list(y)
    for _ in range(horizon):
        w.append(b2[0] + sum(b2[i] * w[-i] for i in range(1, p + 1)) + sum(b2[p + j] * e[-j] for j in range(1, q + 1)))
        e.append(0.0)
        past.append(w[-1] if d == 0 else past[-1] + w[-1] if d == 1 else 2 * past[-1] - past[-2] + w[-1])
    return np.array(past[-horizon:])


def test_arma_grid_against_two_regressions(spark):
    rng = np.random.default_rng(5)
    rows, series = [], {}
    for name in ("a", "b"):
        noise = rng.normal(size=90)
        y = np.zeros(90)
        for t in range(1, 90):
            y[t] = 0.6 * y[t - 1] + noise[t] + 0.5 * noise[t - 1]
        series[name] = 50 + y
        rows += [(name, t, float(v)) for t, v in enumerate(series[name])]
    orders = [(p, d, q) for p in range(3) for d in range(3) for q in range(3) if p + q]
    df = spark.createDataFrame(rows, "s string, t long, y double").repartition(3)
    folds = backtest.backtest_arma(df, ["s"], "t", "y", orders=orders, train=60, horizon=5, step=10, long=3)
    got = {(r.s, r.fold, r.p, r.d, r.q): r.mae for r in folds.collect()}
    want = {}
    for name, y in series.items():
        for fold in range(3):
            part = y[fold * 10 : fold * 10 + 65]
            for p, d, q in orders:
                path = two_stage(part[:60], d, p, q, 3, 5, 5)
                want[name, fold, p, d, q] = np.abs(path - part[60:]).mean()
    assert got.keys() == want.keys()
    for key, mae in want.items():
        assert got[key] == pytest.approx(mae, rel=1e-6), key
    best = [r for r in backtest.arma_grid(folds, ["s"]).collect() if r["rank"] == 1]
    assert len(best) == 2 and all(r.folds == 3 for r in best)


def test_arma_gaps_and_short_series(spark):
    rows = [("gap", t, float(t % 7)) for t in range(40) if t != 33] + [("short", t, 1.0 * t) for t in range(5)]
    df = spark.createDataFrame(rows, "s string, t long, y double")
    out = backtest.backtest_arma(df, ["s"], "t", "y", orders=[(1, 0, 1)], train=30, horizon=5, step=5, long=2).collect()
    assert {(r.s, r.fold): r.mae is None for r in out} == {("gap", 0): True, ("gap", 1): True}


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_share_is_exact(spark, share):
    """Flags of the md5 order, on many sizes, one hot key, a null key and repeated ids."""
    sizes = {"a": 1, "b": 2, "c": 5, "d": 64, "e": 65, "hot": 6000, None: 9}
    rows = [(k, i // 2 if k == "d" else i) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, id long").repartition(5)
    got = regression.split_random(df, ["id"], ["k"], test=share, seed=4).collect()
    for key, n in sizes.items():
        mine = sorted((hashlib.md5(f"4|{r.id}".encode()).hexdigest(), r.id, r.is_train) for r in got if r.k == key)
        assert len(mine) == n
        if key != "d":
            assert [not m[2] for m in mine] == [i < math.ceil(share * n) for i in range(n)]


def test_filled_stream(spark, tmp_path):
    """Silent and late keys, events before the origin, several batches."""
    rnd = random.Random(6)
    origin = dt.date(2024, 1, 3)
    batches = [[], [], []]
    for k in range(300):
        day = rnd.randrange(-2, 40)
        batches[0 if day < 12 else 1 if day < 25 else 2].append(("early" if day < 6 else rnd.choice("xyz"), dt.datetime(2024, 1, 3) + dt.timedelta(day, rnd.randrange(86400))))
    schema = "key string, ts timestamp_ntz"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    with pytest.raises(ValueError):
        intervals.stream_filled_counts(stream, "ts", 5, origin, ["key"])
    spark.conf.set(name, intervals.ROCKSDB)
    try:
        out = intervals.stream_filled_counts(stream, "ts", 5, origin, ["key"], delay="1 day")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    events = [e for rows in batches for e in rows]
    last = max(ts for _, ts in events) - dt.timedelta(1)
    want = []
    for key in sorted({k for k, _ in events}):
        k = 0
        while dt.datetime(2024, 1, 3) + dt.timedelta(5 * (k + 1)) <= last:
            start = origin + dt.timedelta(5 * k)
            n = sum(e == key and start <= ts.date() < start + dt.timedelta(5) for e, ts in events)
            want.append((key, start, start + dt.timedelta(4), n))
            k += 1
    assert got == want and any(r[3] == 0 for r in got)


def test_filled_stream_keeps_keys_of_a_group_apart(spark, tmp_path):
    """All keys in one state value: nulls, long integers, keys that come later, counts across batches."""
    day = lambda d: dt.datetime(2024, 1, d, 12)
    big = 2**60 + 1
    batches = [
        [("a", big, 0.5, day(1)), ("a", None, 0.5, day(1)), (None, big, float("nan"), day(2)), ("a", big, 0.5, day(4))],
        [("a", big, 0.5, day(4)), ("b", 7, -0.0, day(2)), ("b", 7, 0.0, day(9))],
        [(None, big, float("nan"), day(1)), ("a", None, 0.5, day(16))],
    ]
    schema = "k string, n long, x double, ts timestamp_ntz"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, intervals.ROCKSDB)
    try:
        out = intervals.stream_filled_counts(stream, "ts", 7, dt.date(2024, 1, 1), ["k", "n", "x"], delay="1 day", groups=1)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    assert [f.dataType for f in out.schema][:3] == [f.dataType for f in spark.read.parquet(str(tmp_path / "feed")).schema][:3]
    got = sorted((str(r.k), r.n or 0, str(r.x), r.start_date.day, r.n_events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = [("None", big, "nan", 1, 2), ("None", big, "nan", 8, 0), ("a", 0, "0.5", 1, 1), ("a", 0, "0.5", 8, 0)]
    assert got == want + [("a", big, "0.5", 1, 3), ("a", big, "0.5", 8, 0), ("b", 7, "0.0", 1, 1), ("b", 7, "0.0", 8, 1)]


def test_snapshots_keep_null_days(spark, tmp_path):
    feed = str(tmp_path / "feed")
    for k in (1, 2):
        spark.createDataFrame([(None, k, 1)], "day date, id long, version int").coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema("day date, id long, version int").option("maxFilesPerTrigger", 1).parquet(feed)
    intervals.accumulate_snapshots(stream, str(tmp_path / "out"), str(tmp_path / "log"), "day", "version").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
