"""Fixed-length day intervals: anchored forward or backward, gap-filled, complete.

All operators first compact the input to one row per (keys, day) with map-side
combining, spread by (keys, day) so that a hot key is shared out. What follows
works on that compact table, where a series has at most one row per calendar day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebin.functions.columns import as_date, trunc_day
from tidebin.session import settle


def date_bounds(df: DataFrame, date_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """First and last day per key."""
    day = trunc_day(date_col)
    return df.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def _per_day(df, date_col, keys, sums, means):
    measures = [F.sum(c).alias(c) for c in sums]
    for c in means:
        measures += [F.sum(c).alias(f"__sum_{c}"), F.count(c).alias(f"__n_{c}")]
    return (
        df.filter(F.col(date_col).isNotNull())
        .groupBy(*keys, trunc_day(date_col).alias("__day"))
        .agg(*(measures or [F.count(F.lit(1)).alias("__rows")]))
    )


def _per_bin(days, keys, bin_idx, sums, means, bounds):
    measures = [F.sum(c).alias(c) for c in sums]
    measures += [(F.sum(f"__sum_{c}") / F.nullif(F.sum(f"__n_{c}"), F.lit(0))).alias(c) for c in means]
    carried = [F.first(b).alias(b) for b in bounds]
    return days.groupBy(*keys, bin_idx.cast("bigint").alias("bin_idx")).agg(
        *measures, F.count(F.lit(1)).alias("n_days"), *carried
    )


def _filled(df: DataFrame, idx_col: str, zero: Sequence[str], first: Column, last: Column) -> DataFrame:
    """Each row emits the indexes `first` to `last`; inserted ones carry 0 in `zero`."""
    filled = df.withColumn("__at", F.explode(F.sequence(first, last)))
    inserted = F.col("__at") != F.col(idx_col)
    return filled.withColumns(
        {c: F.when(inserted, F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0))) for c in zero}
    ).withColumn(idx_col, F.col("__at")).drop("__at")


def gap_fill(df: DataFrame, keys: Sequence[str] = (), idx_col: str = "bin_idx", zero: Sequence[str] = ()) -> DataFrame:
    """Insert the missing indexes between the first and last of each key.

    Each row emits itself and the gap up to the next row, so no calendar table is
    joined. Columns in `zero` become 0 in inserted rows and where null; other columns
    (such as per-key bounds) are carried on from the row before.
    """
    following = F.lead(idx_col).over(Window.partitionBy(*keys).orderBy(idx_col))
    run = df.withColumn("__next", following)
    return _filled(run, idx_col, zero, F.col(idx_col), F.coalesce(F.col("__next") - 1, F.col(idx_col))).drop("__next")


def _whole_calendar(bins: DataFrame, keys: Sequence[str], freq: int, zero: Sequence[str]) -> DataFrame:
    """Every interval from origin to last day for each key, 0 where it has no row.

    The first row of a key also emits the intervals before it and the last one those after
    it, so there is no grid of keys and intervals to join.
    """
    newest = F.floor(F.datediff("__last", "__origin") / F.lit(freq)).cast("bigint")
    series = Window.partitionBy(*keys).orderBy("bin_idx")
    run = bins.withColumns({"__before": F.lag("bin_idx").over(series), "__next": F.lead("bin_idx").over(series)})
    first = F.when(F.col("__before").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("bin_idx"))
    return _filled(run, "bin_idx", zero, first, F.coalesce(F.col("__next") - 1, newest)).drop("__before", "__next")


def complete_bins(df: DataFrame, freq: int, *, strict: bool = True) -> DataFrame:
    """Keep intervals with `days_to_max >= freq`.

    This is one day stricter than "fully observed": an interval that ends exactly on
    the last day is dropped. `strict=False` keeps it.
    """
    return df.filter(F.col("days_to_max") >= (freq if strict else freq - 1))


def resample_forward(
    df: DataFrame,
    date_col: str,
    freq: int,
    *,
    sums: Sequence[str] = (),
    means: Sequence[str] = (),
    keys: Sequence[str] = (),
    origin: str | dt.date | None = None,
    last_day: str | dt.date | None = None,
    bounds: str = "feed",
    fill: bool = True,
    complete: bool = True,
) -> DataFrame:
    """Intervals `[origin + k*freq, origin + (k+1)*freq)` labelled by their first day.

    `sums` add up, `means` average the non-null rows; empty intervals hold 0. With
    `bounds="feed"` all keys share one calendar, from the first to the last day of the
    whole input (or `origin` and `last_day`), so every key has every interval and sums over
    keys are those of the whole. With `bounds="key"` the calendar of a key runs from its own
    first to its own last interval. Days of keyed series outside
    `origin` and `last_day` do not count in feed bounds. Returns keys, bin_idx, start_date, end_date, measures, n_days and
    days_to_max.
    """
    if bounds not in ("feed", "key"):
        raise ValueError(f"unknown bounds: {bounds}")
    series = Window.partitionBy(*keys)
    days = _per_day(df, date_col, keys, sums, means)
    shared = bool(keys) and bounds == "feed"
    if shared:
        if origin is None or last_day is None:
            # the compact table is read for its bounds and again for its intervals
            days = settle(days)
        ends = days.agg(F.struct(F.min("__day").alias("lo"), F.max("__day").alias("hi")).alias("s")).scalar()
        first = ends["lo"] if origin is None else as_date(origin)
        last = ends["hi"] if last_day is None else as_date(last_day)
        days = days.withColumns({"__origin": first, "__last": last})
        days = days.filter((F.col("__day") >= F.col("__origin")) & (F.col("__day") <= F.col("__last")))
    else:
        first = F.min("__day").over(series) if origin is None else as_date(origin)
        last = F.max("__day").over(series) if last_day is None else as_date(last_day)
        days = days.withColumns({"__origin": first, "__last": last})
    bin_idx = F.floor(F.datediff("__day", "__origin") / F.lit(freq))
    bins = _per_bin(days, keys, bin_idx, sums, means, ["__origin", "__last"])
    if fill and shared:
        bins = _whole_calendar(bins, keys, freq, [*sums, *means, "n_days"])
    elif fill:
        bins = gap_fill(bins, keys, zero=[*sums, *means, "n_days"])
    start = F.date_add("__origin", (F.col("bin_idx") * freq).cast("int"))
    out = bins.withColumn("start_date", start).select(
        *keys,
        "bin_idx",
        "start_date",
        F.date_add("start_date", freq - 1).alias("end_date"),
        *sums,
        *means,
        "n_days",
        F.datediff("__last", "start_date").alias("days_to_max"),
    )
    return complete_bins(out, freq) if complete else out


def resample_backward(
    df: DataFrame,
    date_col: str,
    freq: int,
    *,
    means: Sequence[str],
    keys: Sequence[str] = (),
    last_day: str | dt.date | None = None,
    rounded: bool = True,
) -> DataFrame:
    """Mean per interval `(last - (k+1)*freq, last - k*freq]`, labelled by its last day.

    Means are rounded half to even, empty intervals hold 0. The oldest interval may be
    partial and is kept; `n_days` tells how many days it saw. `bin_idx` counts upward
    in time from 0.
    """
    series = Window.partitionBy(*keys)
    days = _per_day(df, date_col, keys, (), means).withColumns(
        {
            "__last": F.max("__day").over(series) if last_day is None else as_date(last_day),
            "__first": F.min("__day").over(series),
        }
    )
    steps_back = F.floor(F.datediff("__last", "__day") / F.lit(freq))
    oldest = F.floor(F.datediff("__last", "__first") / F.lit(freq))
    days = days.withColumn("__oldest", oldest.cast("bigint"))
    bins = _per_bin(days, keys, F.col("__oldest") - steps_back, (), means, ["__last", "__oldest"])
    bins = gap_fill(bins, keys, zero=[*means, "n_days"])
    end = F.date_sub("__last", ((F.col("__oldest") - F.col("bin_idx")) * freq).cast("int"))
    return bins.withColumn("end_date", end).select(
        *keys,
        "bin_idx",
        F.date_sub("end_date", freq - 1).alias("start_date"),
        "end_date",
        *[(F.bround(c, 0) if rounded else F.col(c)).alias(c) for c in means],
        "n_days",
    )


def with_position(df: DataFrame, freq: int, date_col: str = "start_date", origin: Column | str | dt.date | None = None) -> DataFrame:
    """Consecutive integer positions for tables that carry only interval dates."""
    base = as_date(origin) if origin is not None else df.agg(F.min(date_col)).scalar()
    return df.withColumn("bin_idx", F.floor(F.datediff(F.col(date_col), base) / F.lit(freq)).cast("bigint"))
