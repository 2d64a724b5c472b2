"""Putting several interval series side by side on their interval keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

INTERVAL = ("start_date", "end_date")


def align(tables: Sequence[DataFrame], how: str = "inner", on: Sequence[str] = INTERVAL) -> DataFrame:
    """Join interval tables on their keys; `left` keeps every interval of the first.

    Inputs must share one origin, or their intervals never coincide. No join hint:
    interval tables are small enough to be broadcast by size, and very many series
    fall back to a sort-merge join.
    """
    return reduce(lambda a, b: a.join(b, list(on), how), tables)


def align_inner(*tables: DataFrame, on: Sequence[str] = INTERVAL) -> DataFrame:
    return align(tables, "inner", on)


def align_left(first: DataFrame, *others: DataFrame, on: Sequence[str] = INTERVAL, drop_nulls: bool = False) -> DataFrame:
    joined = align((first, *others), "left", on)
    return joined.dropna("any") if drop_nulls else joined


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "series", value: str = "y") -> DataFrame:
    """One row per (ids, series): every series operator then runs once for all columns."""
    return df.select(*ids, *[df[c].cast("double").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), name, value
    )
