"""Interval counts over an event stream, and accumulation of daily snapshots."""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidebin.functions.columns import MICROS_PER_DAY

EPOCH = dt.date(1970, 1, 1)
MS_PER_DAY = 86_400_000
#: Groups of keys that share a state value, and rows that a task hands on at once.
GROUPS, EMIT_ROWS = 1024, 100_000


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """The events with their instant as `__ts` under a watermark."""
    instant = F.col(ts)
    if isinstance(events.schema[ts].dataType, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(ts)))
    return events.withColumn("__ts", instant).withWatermark("__ts", delay)


def stream_interval_counts(
    events: DataFrame, ts: str, freq: int, origin: dt.date, keys: Sequence[str] = (), *, delay: str = "1 day"
) -> DataFrame:
    """Counts per interval `[origin + k*freq, origin + (k+1)*freq)` days that has events.

    In append mode an interval is emitted once the watermark has passed its end, the
    streaming counterpart of keeping complete intervals only. Naive timestamps are taken
    as they stand, whatever the session time zone; zoned ones are cut at UTC midnight.
    """
    offset = (origin - EPOCH).days % freq
    interval = F.window("__ts", f"{freq} days", startTime=f"{offset} days")
    counts = _timed(events, ts, delay).groupBy(interval, *keys).agg(F.count(F.lit(1)).alias("n_events"))
    start = F.date_add(F.lit(EPOCH), F.floor(F.unix_micros("window.start") / MICROS_PER_DAY).cast("int"))
    return counts.select(*keys, start.alias("start_date"), F.date_add(start, freq - 1).alias("end_date"), "n_events")


class ClosedIntervals(StatefulProcessor):
    """Open counts by key and interval of a group of keys, and the interval that it has to emit next.

    A timer stands at the end of that interval, so a key that falls silent still emits:
    every interval up to the watermark once and in order, with 0 where nothing came. The
    keys of a group share one state value, which a batch reads and writes once.
    """

    def __init__(self, n_keys: int, freq: int, origin: dt.date):
        self.n_keys, self.freq, self.origin = n_keys, freq, origin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", T.StructType([T.StructField("next", T.LongType()), T.StructField("counts", T.StringType())]))

    def end_ms(self, interval: int) -> int:
        return ((self.origin - EPOCH).days + (interval + 1) * self.freq) * MS_PER_DAY

    def loaded(self) -> tuple[int, dict[tuple, dict[int, int]]]:
        if not self.held.exists():
            return 0, {}
        first, counts = self.held.get()
        return first, {tuple(key): dict(of_key) for key, of_key in json.loads(counts)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, held = self.loaded()
        new = set()
        for part in rows:
            seen = Counter(zip(*(part.iloc[:, i] for i in range(self.n_keys + 1))))
            for (*values, interval), n in seen.items():
                of = tuple(v if isinstance(v, str) else None for v in values)
                if of not in held:
                    held[of] = {}
                    new.add(of)
                # intervals before are out already, or lie before the origin; unknown times count nowhere
                if pd.notna(interval) and interval >= (0 if of in new else first):
                    held[of][int(interval)] = held[of].get(int(interval), 0) + n
        yield from self.closed(first, held, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.closed(*self.loaded(), set(), timerValues.getCurrentWatermarkInMs())

    def closed(self, first: int, held: dict[tuple, dict[int, int]], new: set[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        last = first
        while self.end_ms(last) <= watermark:
            last += 1
        out = []
        for key, counts in held.items():
            for interval in range(0 if key in new else first, last):
                start = self.origin + dt.timedelta(interval * self.freq)
                out.append((*key, start, start + dt.timedelta(self.freq - 1), counts.pop(interval, 0)))
                if len(out) == EMIT_ROWS:
                    yield pd.DataFrame(out, columns=range(self.n_keys + 3))
                    out = []
        if out:
            yield pd.DataFrame(out, columns=range(self.n_keys + 3))
        self.held.update((last, json.dumps([[key, list(counts.items())] for key, counts in held.items()])))
        self.handle.registerTimer(self.end_ms(last))

    def close(self) -> None:
        pass


def _as_text(name: str, kind: T.DataType) -> Column:
    """A key as text that `_from_text` takes back exactly; nulls stay null."""
    col = F.col(name)
    if isinstance(kind, T.BinaryType):
        return F.hex(col)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(col == 0, F.lit(0).cast(kind)).otherwise(col).cast("string")
    return F.to_json(col) if isinstance(kind, (T.ArrayType, T.StructType)) else col.cast("string")


def _from_text(name: str, kind: T.DataType) -> Column:
    col = F.col(name)
    if isinstance(kind, T.BinaryType):
        return F.unhex(col)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(col.cast("long"))
    return F.from_json(col, kind) if isinstance(kind, (T.ArrayType, T.StructType)) else col.cast(kind)


def stream_filled_counts(
    events: DataFrame, ts: str, freq: int, origin: dt.date, keys: Sequence[str] = (), *, delay: str = "1 day", groups: int = GROUPS
) -> DataFrame:
    """Counts of every interval from `origin` on, 0 where a key had no events.

    A key emits an interval once the watermark has passed its end, whether or not events of
    the key still come; a key that first appears late then emits its earlier intervals too.
    An event counts as long as its interval is open, however late it is; events before the
    origin do not count. Over the whole stream this is `resample_forward` with feed bounds,
    cut at the watermark. State is one number for each open interval and key, in RocksDB;
    keys are dealt to `groups` by their hash, and a task holds one group at a time. The
    number of groups is fixed for the life of a stream's checkpoint.
    """
    provider = events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if provider != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    days = F.floor(F.unix_micros("__ts") / MICROS_PER_DAY) - (origin - EPOCH).days
    kinds = {k: events.schema[k].dataType for k in keys}
    rows = _timed(events, ts, delay).select(*[_as_text(k, t).alias(k) for k, t in kinds.items()], F.floor(days / freq).alias("__interval"), "__ts")
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)) if keys else F.lit(0)
    grouped = rows.select(*keys, "__interval", group.alias("__group"), "__ts").drop("__ts").groupBy("__group")
    fields = [T.StructField(k, T.StringType()) for k in keys] + T.StructType.fromDDL("start_date date, end_date date, n_events long").fields
    out = grouped.transformWithStateInPandas(ClosedIntervals(len(keys), freq, origin), T.StructType(fields), "Append", "EventTime")
    return out.select(*[_from_text(k, t).alias(k) for k, t in kinds.items()], "start_date", "end_date", "n_events")


def accumulate_snapshots(
    snapshots: DataFrame, path: str, checkpoint: str, day: str, version: str, *, available_now: bool = True
) -> StreamingQuery:
    """Keep one snapshot per day: its newest delivery, by `version`.

    The stored rows of a day are the distinct rows of the newest version that has come, in
    whatever order deliveries arrive and however they are cut into micro-batches: a newer
    version replaces a day, rows of the stored version join it, older ones are ignored.
    Rows with a null day are a day of their own. Replaying a batch changes nothing. A batch is read once: its rows and the stored rows of
    its days are staged beside the checkpoint, and only those days are overwritten.
    """

    def merge_days(batch: DataFrame, _: int) -> None:
        session, names = batch.sparkSession, batch.columns
        arrived, staged = f"{checkpoint}-staged/arrived", f"{checkpoint}-staged/merged"
        batch.write.mode("overwrite").parquet(arrived)
        rows = session.read.schema(batch.schema).parquet(arrived)
        try:
            stored = session.read.schema(batch.schema).parquet(path).select(*names)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            days = rows.select(F.col(day).alias("__arrived")).distinct()
            rows = rows.unionByName(stored.join(days, F.col(day).eqNullSafe(F.col("__arrived")), "left_semi").select(*names))
        newest = rows.groupBy(F.col(day).alias("__day")).agg(F.max(version).alias("__version"))
        same = F.col(day).eqNullSafe(F.col("__day")) & F.col(version).eqNullSafe(F.col("__version"))
        rows.join(newest, same).select(*names).distinct().write.mode("overwrite").parquet(staged)
        merged = session.read.schema(batch.schema).parquet(staged)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    writer = snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge_days)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
