"""Series with missing positions, keyed feeds on one calendar, and snapshot order."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from tidebin.operators import backtest, bins, common, regression, signal
from tidebin.plans import pipelines
from tidebin.streaming import intervals as streams

POSITIONS = [0, 1, 2, 3, 4, 5, 9, 10, 12, 13, 14, 15, 16, 17, 18]


def series(spark, positions=POSITIONS):
    return spark.createDataFrame([("k", p, float(p * p % 31)) for p in positions], "k string, pos long, y double")


@pytest.mark.parametrize("size", [4, 4096])
def test_lags_are_of_positions(spark, size):
    value = {p: float(p * p % 31) for p in POSITIONS}
    out = common.with_lags(series(spark), ["k"], "pos", {"back": ("y", 2), "ahead": ("y", -1)}, size)
    got = {r.pos: (r.back, r.ahead) for r in out.collect()}
    assert got == {p: (value.get(p - 2), value.get(p + 1)) for p in POSITIONS}


def test_difference_and_trend_stop_at_gaps(spark):
    value = {p: float(p * p % 31) for p in POSITIONS}
    diff = {r.pos: r.y for r in signal.difference(series(spark), ["k"], "pos", "y").collect()}
    assert diff == {p: value[p] - value[p - 1] for p in POSITIONS if p - 1 in value}
    trend = {r.pos: r.trend for r in signal.centered_trend(series(spark), ["k"], "pos", "y", 4).collect()}
    want = {}
    for p in POSITIONS:
        frame = [value.get(p + i) for i in range(-2, 3)]
        want[p] = None if None in frame else (sum(frame[1:4]) + (frame[0] + frame[4]) / 2) / 4
    assert trend == pytest.approx(want)


def test_first_rows_train_whatever_the_gaps(spark):
    positions = [p for p in range(9000) if p % 3 or p > 6000]
    out = regression.split_chronological(series(spark, positions), "pos", ["k"])
    flags = [r.is_train for r in out.orderBy("pos").collect()]
    n = int(0.8 * len(positions))
    assert flags == [True] * n + [False] * (len(positions) - n)


def test_folds_reach_the_last_position(spark):
    positions = [p for p in range(80) if p not in (20, 21, 50)]
    folds = backtest.backtest_folds(series(spark, positions), ["k"], "pos", "y", orders=[(1, 0)], train=36, horizon=6, step=6)
    got = {r.fold: r.mae for r in folds.collect()}
    assert sorted(got) == list(range(7))
    assert [f for f, e in got.items() if e is None] == [2]  # tests on 48..53, where 50 is missing


def test_one_calendar_for_all_keys(spark):
    day = lambda m, d: dt.date(2024, m, d)
    rows = [("a", day(1, 1) + dt.timedelta(days=i)) for i in range(100)] + [("b", day(1, 20)), ("b", day(2, 10))]
    feed = spark.createDataFrame(rows, "key string, day date").withColumn("n", F.lit(1).cast("long"))
    out = bins.resample_forward(feed, "day", 10, sums=["n"], keys=["key"], origin="2024-01-01").collect()
    whole = bins.resample_forward(feed, "day", 10, sums=["n"], origin="2024-01-01").collect()
    assert {k: sum(1 for r in out if r.key == k) for k in "ab"} == {"a": len(whole), "b": len(whole)}
    assert sum(r.n for r in out if r.key == "b") == 2
    assert [sum(r.n for r in out if r.bin_idx == w.bin_idx) for w in whole] == [w.n for w in whole]
    late = bins.resample_forward(feed, "day", 10, sums=["n"], keys=["key"], last_day="2024-02-05").collect()
    assert {(r.key, r.bin_idx) for r in late} == {(k, i) for k in "ab" for i in range(3)}
    keyed = bins.resample_forward(feed, "day", 10, sums=["n"], keys=["key"])
    assert "Join" not in keyed._jdf.queryExecution().optimizedPlan().toString()
    own = bins.resample_forward(feed, "day", 10, sums=["n"], keys=["key"], bounds="key", complete=False)
    assert own.filter("key = 'b'").count() == 3
    with pytest.raises(ValueError):
        bins.resample_forward(feed, "day", 10, sums=["n"], bounds="none")


def test_feed_is_filtered_by_since_too(spark):
    rows = [(i, dt.datetime(2023, m, 5)) for i, m in enumerate([1, 2, 3, 4])]
    new = [(10 + i, dt.datetime(2023, m, 5)) for i, m in enumerate([3, 6, 7, 8, 9])]
    schema = "id long, at timestamp_ntz"
    out = pipelines.interval_rule_counts(
        spark.createDataFrame(rows, schema), spark.createDataFrame(new, schema), "2023-07-01", 30,
        date_col="at", id_col="id", rules={"n": F.lit(True)},
    )
    got = sorted((r.start_date, r.n) for r in out.collect())
    assert got[0][0] == dt.date(2023, 7, 5) and sum(n for _, n in got) == 2


def run_snapshots(spark, folder, files, schema):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/src/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/src")
    streams.accumulate_snapshots(stream, f"{folder}/out", f"{folder}/log", "day", "delivery").awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(schema).parquet(f"{folder}/out").select("day", "id", "delivery").collect())


def test_snapshot_rows_survive_any_cut_and_order(spark, tmp_path):
    schema = "day date, id long, delivery int"
    a, b = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    files = [[(a, i, 1) for i in range(5)], [(a, i, 2) for i in (7, 8)] + [(b, 1, 1)], [(a, i, 2) for i in (8, 9)], [(a, i, 1) for i in (5, 6)]]
    want = [(a, 7, 2), (a, 8, 2), (a, 9, 2), (b, 1, 1)]
    for k, order in enumerate(itertools.islice(itertools.permutations(files), 0, 24, 8)):
        assert run_snapshots(spark, tmp_path / str(k), order, schema) == want
    assert len(run_snapshots(spark, tmp_path / "one", [[(a, 5 * f + i, 1) for i in range(5)] for f in range(3)], schema)) == 15
