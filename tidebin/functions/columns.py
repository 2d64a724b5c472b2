"""Column expressions and projections; everything stays inside codegen."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_date(value: str | dt.date | Column) -> Column:
    """A date literal from text or a Python date; columns pass through."""
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def trunc_day(ts: str | Column) -> Column:
    return F.to_date(as_column(ts))


def local_date(ts: str | Column, zone: str | None = None) -> Column:
    """Calendar date of a naive timestamp, or of a UTC instant seen in `zone`."""
    ts = as_column(ts)
    return F.to_date(ts if zone is None else F.from_utc_timestamp(ts, zone))


def add_days(date: str | Column, days: int | Column) -> Column:
    return F.date_add(as_column(date), days)


def sub_days(date: str | Column, days: int | Column) -> Column:
    return F.date_sub(as_column(date), days)


def days_between(start: str | Column, end: str | Column) -> Column:
    """Calendar days from start to end."""
    return F.datediff(as_column(end), as_column(start))


def elapsed_days(start: str | Column, end: str | Column) -> Column:
    """Whole days elapsed, floored for negative spans too (integer arithmetic)."""
    micros = F.timestamp_diff("MICROSECOND", as_column(start), as_column(end))
    day = F.lit(MICROS_PER_DAY).cast("bigint")
    return ((micros - F.pmod(micros, day)) / day).cast("int")


def round_half_even(x: str | Column, scale: int = 0) -> Column:
    return F.bround(as_column(x), scale)


def null_if_zero(x: str | Column) -> Column:
    x = as_column(x)
    return F.when(x != 0, x)


def coalesce_zero(x: str | Column) -> Column:
    return F.coalesce(as_column(x), F.lit(0))


def era(date: str | Column, cutoff: str | dt.date, before: str = "pre", after: str = "post") -> Column:
    """Two-period label: strictly before the cutoff, or on and after it."""
    return F.when(as_column(date) < as_date(cutoff), before).otherwise(after)


def filter_since(df: DataFrame, date_col: str, start: str | dt.date, *, strict: bool = False) -> DataFrame:
    """Rows from `start` on; the bare column keeps the predicate pushable to parquet."""
    bound = F.lit(start).cast(df.schema[date_col].dataType)
    return df.filter(F.col(date_col) > bound if strict else F.col(date_col) >= bound)


def with_date_parts(df: DataFrame, date_col: str = "start_date", month: str = "month", year: str = "year") -> DataFrame:
    return df.withColumns({month: F.month(date_col), year: F.year(date_col)})


def log1p_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """log(1+x) in place. Values at or below -1 become null, not -inf or NaN."""
    return df.withColumns({c: F.log1p(c) for c in cols})


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Columns that start with the prefix (a substring match would also take look-alikes)."""
    return [c for c in df.columns if c.startswith(prefix)]
