import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebin.functions import elapsed_days
from tidebin.operators import bins, counts

D = dt.date(2020, 1, 1)


def days(spark, offsets, values=None, start=D):
    values = values or [1.0] * len(offsets)
    rows = [(start + dt.timedelta(days=o), v) for o, v in zip(offsets, values)]
    return spark.createDataFrame(rows, "day date, v double")


def test_empty_middle_bin_is_zero(spark):
    out = bins.resample_forward(days(spark, [0, 65]), "day", 30, sums=["v"], complete=False).orderBy("bin_idx").collect()
    assert [(r.bin_idx, r.v, r.n_days) for r in out] == [(0, 1.0, 1), (1, 0.0, 0), (2, 1.0, 1)]
    assert out[1].start_date == D + dt.timedelta(days=30)


def test_mean_of_all_null_bin_is_zero(spark):
    df = days(spark, [0, 31, 62, 95], [2.0, None, 4.0, 5.0])
    out = bins.resample_forward(df, "day", 30, means=["v"]).orderBy("bin_idx").collect()
    assert [r.v for r in out] == [2.0, 0.0, 4.0]


def test_bin_ending_on_the_last_day_is_dropped(spark):
    df = days(spark, range(14))
    strict = bins.resample_forward(df, "day", 7, sums=["v"])
    every = bins.resample_forward(df, "day", 7, sums=["v"], complete=False)
    assert strict.count() == 1
    assert bins.complete_bins(every, 7, strict=False).count() == 2


def test_backward_partial_first_bin(spark):
    n = (dt.date(2024, 9, 29) - dt.date(2016, 6, 2)).days + 1
    df = days(spark, range(n), start=dt.date(2016, 6, 2))
    month = bins.resample_backward(df, "day", 30, means=["v"]).orderBy("bin_idx").collect()
    week = bins.resample_backward(df, "day", 7, means=["v"]).orderBy("bin_idx").collect()
    assert (len(month), month[0].end_date, month[0].n_days) == (102, dt.date(2016, 6, 13), 12)
    assert month[0].start_date == dt.date(2016, 5, 15) and month[-1].end_date == dt.date(2024, 9, 29)
    assert (len(week), week[0].end_date, week[0].n_days) == (435, dt.date(2016, 6, 5), 4)


def test_means_round_half_to_even(spark):
    df = days(spark, [0, 1, 2, 3, 4, 5], [0.0, 1.0, 1.0, 2.0, 2.0, 3.0])
    out = bins.resample_backward(df, "day", 2, means=["v"]).orderBy("bin_idx").collect()
    assert [r.v for r in out] == [0.0, 2.0, 2.0]


def test_additivity_of_interval_lengths(spark):
    df = days(spark, range(400), [float(i * i % 17) for i in range(400)])
    month = bins.resample_forward(df, "day", 30, sums=["v"]).filter("bin_idx < 7").agg(F.sum("v")).first()[0]
    week = bins.resample_forward(df, "day", 7, sums=["v"]).filter("bin_idx < 30").agg(F.sum("v")).first()[0]
    assert month == week


def test_null_keys_and_dates(spark):
    rows = [("a", D, 1.0), (None, D, 2.0), (None, D + dt.timedelta(days=40), 3.0), ("a", None, 9.0)]
    df = spark.createDataFrame(rows, "k string, day date, v double")
    out = bins.resample_forward(df, "day", 30, sums=["v"], keys=["k"], complete=False, bounds="key").collect()
    assert sorted((r.k or "", r.bin_idx, r.v) for r in out) == [("", 0, 2.0), ("", 1, 3.0), ("a", 0, 1.0)]
    feed = bins.resample_forward(df, "day", 30, sums=["v"], keys=["k"], complete=False).collect()
    assert sorted((r.k or "", r.bin_idx, r.v) for r in feed) == [("", 0, 2.0), ("", 1, 3.0), ("a", 0, 1.0), ("a", 1, 0.0)]


def test_shared_origin_makes_series_meet(spark):
    a = bins.resample_forward(days(spark, [3, 40, 80]), "day", 30, sums=["v"], origin=D, complete=False)
    assert a.orderBy("bin_idx").first().start_date == D


def test_elapsed_days_floors(spark):
    row = spark.sql(
        "select timestamp_ntz'2024-01-02 01:00:00' a, timestamp_ntz'2024-01-01 23:00:00' b"
    ).select(elapsed_days("a", "b").alias("back"), elapsed_days("b", "a").alias("on")).first()
    assert (row.back, row.on) == (-1, 0)


def test_distinct_per_day_then_summed(spark):
    rows = [(D, 1), (D, 1), (D, 2), (D + dt.timedelta(days=1), 1), (D + dt.timedelta(days=60), 5)]
    df = spark.createDataFrame(rows, "day date, id long")
    daily = counts.daily_distinct_count(df, "day", "id", "n")
    out = bins.resample_forward(daily, "day", 30, sums=["n"]).orderBy("bin_idx").collect()
    assert [r.n for r in out] == [3, 0]


def test_cutover_counts_overlap_once(spark):
    old = spark.createDataFrame([(D + dt.timedelta(days=i), "old") for i in range(11)], "day date, src string")
    new = spark.createDataFrame([(D + dt.timedelta(days=i), "new") for i in range(8, 15)], "day date, src string")
    out = counts.union_with_cutover(old, new, "day").collect()
    assert len(out) == 15 and sum(r.src == "new" for r in out) == 4
    assert counts.union_with_cutover(old.limit(0), new, "day").count() == 7


@pytest.mark.parametrize("approximate", [False, True])
def test_daily_distinct_modes(spark, approximate):
    df = spark.createDataFrame([(D, i % 5) for i in range(50)], "day date, id long")
    assert counts.daily_distinct_count(df, "day", "id", "n", approximate=approximate).first().n == 5
