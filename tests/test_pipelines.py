import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebin.plans import pipelines

T0 = dt.datetime(2016, 5, 15)


def records(spark, rows):
    return spark.createDataFrame(
        rows, "CMPLNT_NUM string, CMPLNT_FR_DT timestamp_ntz, LAW_CAT_CD string, OFNS_DESC string"
    )


def test_overlapping_offence_rules(spark):
    rows = [
        ("1", T0, "FELONY", "FELONY ASSAULT"),
        ("2", T0, "FELONY", "ROBBERY"),
        ("3", T0, "MISDEMEANOR", "ASSAULT 3 & RELATED"),
        (None, T0, "FELONY", "ROBBERY"),
        ("5", T0, "FELONY", "GRAND LARCENY"),
        ("6", T0, "FELONY", "GRAND LARCENY OF MOTOR VEHICLE"),
        ("7", T0 + dt.timedelta(days=45), "FELONY", None),
        ("8", T0 - dt.timedelta(days=1), "FELONY", "ROBBERY"),
    ]
    out = pipelines.interval_rule_counts(
        records(spark, rows), None, "2016-05-15", 30, date_col="CMPLNT_FR_DT", id_col="CMPLNT_NUM",
        rules=pipelines.complaint_rules(),
    )
    row = out.orderBy("bin_idx").first()
    assert row.total_felony_crimes == 4 and row.violent_felony_crimes == 2 and row.total_misdemeanor_crimes == 1
    assert row.assault_count == 1 and row.robbery_count == 1
    assert row.grand_larceny_count == 1 and row.grand_larceny_vehicle_count == 1
    assert row.murder_homicide_count == row.burglary_count == row.rape_count == row.weapons_count == 0
    assert len(pipelines.arrest_rules()) == 11 and "arrest_weapons_count" in pipelines.arrest_rules()


def test_stays_are_distinct_and_averaged(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    rows = [(1, day(-10), day(0)), (1, day(-10), day(0)), (2, day(-20), day(1)), (3, day(0), day(70))]
    df = spark.createDataFrame(rows, "INMATEID long, ADMITTED_DT timestamp_ntz, DISCHARGED_DT timestamp_ntz")
    out = pipelines.interval_mean_stay(df, "2016-05-15", 30).orderBy("bin_idx").collect()
    assert [(r.avg_los_days, r.month, r.year) for r in out] == [(15.5, 5, 2016), (0.0, 6, 2016)]


def test_population_fills_missing_weeks(spark):
    rows = [(T0.date() + dt.timedelta(days=d), float(v)) for d, v in [(0, 10), (1, 10), (21, 40)]]
    df = spark.createDataFrame(rows, "snapshot_date date, `Total Population` double")
    plain = pipelines.interval_population(df, 7).orderBy("bin_idx").collect()
    filled = pipelines.interval_population(df, 7, interpolate=True).orderBy("bin_idx").collect()
    assert [r.adp for r in plain] == [10.0, 10.0, 0.0, 40.0]
    assert [r.adp for r in filled] == [10.0, 10.0, 25.0, 40.0]


def test_unknown_column_raises(spark):
    df = spark.createDataFrame([(1, T0)], "INMATEID long, ADMITTED_DT timestamp_ntz")
    with pytest.raises(ValueError, match="NOT_THERE"):
        pipelines.interval_distinct_counts(df, "2016-05-15", 30, date_col="NOT_THERE", out="n")


def test_study_table_keeps_complete_rows(spark):
    a = spark.createDataFrame([(T0.date(), T0.date(), 1.0), (T0.date(), None, 2.0)], "start_date date, end_date date, adp double")
    b = spark.createDataFrame([(T0.date(), T0.date(), 3.0)], "start_date date, end_date date, x double")
    row = pipelines.study_table(a, b, log_cols=["adp"]).collect()
    assert len(row) == 1 and abs(row[0].adp - 0.6931471805599453) < 1e-12


def test_since_filter_reaches_the_scan(spark, sf_dir):
    plan = pipelines.interval_distinct_counts(
        spark.read.parquet(f"{sf_dir}/orders.parquet"), "1999-01-01", 30, date_col="o_orderdate", id_col="o_custkey", out="n"
    )
    text = plan._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_rules_need_one_raw_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rules = {t: F.col("event_type") == t for t in ("click", "view")}
    plan = pipelines.interval_rule_counts(events, None, "2024-01-01", 7, date_col="ts", id_col="event_id", rules=rules)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Join" not in text
