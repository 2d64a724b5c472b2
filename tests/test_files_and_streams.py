import datetime as dt
import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidebin.session import settle
from tidebin.sources import parse_json_records, read_interval_csv, read_json_array, read_json_records, read_object_csv, write_interval_csv
from tidebin.streaming import intervals as streams


def test_csv_with_index_and_repeated_header(spark, tmp_path):
    path = tmp_path / "week.csv"
    path.write_text(",Start Date,End Date,End Date,n\n0,2016-05-15,2016-05-21,2016-05-21,7\n1,2016-05-22,2016-05-28,2016-05-28,9\n")
    df = read_interval_csv(spark, str(path), "start_date date, end_date date, again date, n bigint").drop("again")
    assert [tuple(r) for r in df.orderBy("n").collect()][0] == (dt.date(2016, 5, 15), dt.date(2016, 5, 21), 7)
    write_interval_csv(df, str(tmp_path / "out"))
    back = read_interval_csv(spark, str(tmp_path / "out"), "start_date date, end_date date, n bigint", index=False)
    assert back.exceptAll(df).count() == 0 and back.count() == 2


def test_missing_object_raises(spark, tmp_path):
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_object_csv(spark, str(tmp_path / "nothing.csv"), "a bigint").collect()


def test_json_numbers_are_cast_strictly(spark, tmp_path):
    good, bad, gap = (tmp_path / n for n in ("good.json", "bad.json", "gap.json"))
    good.write_text('[{"day": "2020-01-01", "n": "3"}, {"day": "2020-01-02", "n": 4}]')
    bad.write_text('[{"day": "2020-01-01", "n": "x"}]')
    gap.write_text('[{"day": "2020-01-01"}]')
    schema = "day date, n bigint not null"
    assert [r.n for r in read_json_records(spark, str(good), schema).orderBy("day").collect()] == [3, 4]
    for path in (bad, gap):
        with pytest.raises((PySparkException, Py4JJavaError)):
            read_json_records(spark, str(path), schema).collect()
    text = spark.createDataFrame([(1, '{"n": "5"}')], "id long, body string")
    assert parse_json_records(text, "body", "n int", ["id"]).first().n == 5


def test_settled_table_is_the_same(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 1.5)
    back = settle(df)
    assert back.dtypes == df.dtypes and back.exceptAll(df).count() == 0
    assert "Range" not in back._jdf.queryExecution().toString()


def write_events(spark, path, rows):
    spark.createDataFrame(rows, "ts timestamp_ntz, kind string").coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_and_accepts_late_rows(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    t0 = dt.datetime(2024, 1, 1)
    stream = lambda: spark.readStream.schema("ts timestamp_ntz, kind string").parquet(src)

    def run():
        counts = streams.stream_interval_counts(stream(), "ts", 7, dt.date(2024, 1, 1), ["kind"], delay="2 days")
        q = counts.writeStream.format("parquet").outputMode("append").option("path", out)
        q.option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return {(r.kind, r.start_date, r.end_date, r.n_events) for r in spark.read.parquet(out).collect()}

    write_events(spark, src, [(t0 + dt.timedelta(hours=5 * i), "ab"[i % 2]) for i in range(38)])  # up to day 7.7
    assert run() == set() or all(r[1] > dt.date(2024, 1, 1) for r in run())
    # late but within the delay: still counted in the first week
    write_events(spark, src, [(t0 + dt.timedelta(days=6, hours=23), "a"), (t0 + dt.timedelta(days=20), "a")])
    got = run()
    week = (dt.date(2024, 1, 1), dt.date(2024, 1, 7))
    first = sum(1 for i in range(38) if 5 * i < 168)
    assert sum(r[3] for r in got if r[1:3] == week) == first + 1
    assert all(r[2] < dt.date(2024, 1, 19) for r in got)


def test_snapshot_redelivery_replaces_the_day(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    schema = "day date, id long, delivery int"
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        streams.accumulate_snapshots(stream, out, log, "day", "delivery").awaitTermination()
        return sorted((r.day, r.id) for r in spark.read.schema(schema).parquet(out).collect())

    assert deliver([(d1, 1, 1), (d1, 2, 1), (d2, 1, 1)]) == [(d1, 1), (d1, 2), (d2, 1)]
    assert deliver([(d1, 3, 2), (d1, 9, 1)]) == [(d1, 3), (d2, 1)]


@pytest.mark.parametrize("block", [60, 300, 1 << 20])
def test_json_array_in_blocks(spark, tmp_path, block):
    """Records across blocks, braces, quotes and escapes in strings; equal to the multi-line reader."""
    rnd = random.Random(block)
    parts = ["{", "}", '"', "\\", "[", "]", ",", ":", "\n", "é", "日本", "a", " ", "}}", '"}', "\\\\\""]
    for name, n in (("a", 0), ("b", 1), ("c", 200), ("d", 40)):
        rows = [{"id": str(i), "text": "".join(rnd.choices(parts, k=rnd.choice([0, 3, 30, 200])))} for i in range(n)]
        rows += [{"id": "7", "text": None}] if n else []
        text = json.dumps(rows, indent=rnd.choice([None, 2]), ensure_ascii=name == "c")
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    schema = "id bigint not null, text string"
    want = sorted(map(repr, read_json_records(spark, str(tmp_path), schema).collect()))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, block)
    try:
        df = read_json_array(spark, str(tmp_path), schema)
        assert sorted(map(repr, df.collect())) == want and len(want) == 244
    finally:
        spark.conf.set(name, before)
