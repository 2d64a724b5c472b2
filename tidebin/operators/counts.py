"""Daily aggregates of raw event records, and joining up two feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebin.functions.columns import trunc_day


def daily_distinct_count(
    df: DataFrame, date_col: str, id_col: str, out: str, keys: Sequence[str] = (), *, approximate: bool = False
) -> DataFrame:
    """Distinct ids per day. Exact by default; Spark first spreads the rows by
    (day, id), so a busy day is never handled by one task."""
    count = F.approx_count_distinct(id_col) if approximate else F.count_distinct(F.col(id_col))
    return (
        df.filter(F.col(date_col).isNotNull())
        .groupBy(*keys, trunc_day(date_col).alias("day"))
        .agg(count.alias(out))
    )


def daily_rule_counts(
    df: DataFrame, date_col: str, id_col: str, rules: Mapping[str, Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Per day and rule, the number of rows with a non-null id that satisfy the rule.

    Rules may overlap, so each one is its own conditional count; all of them share
    one scan and one aggregate.
    """
    return (
        df.filter(F.col(date_col).isNotNull())
        .groupBy(*keys, trunc_day(date_col).alias("day"))
        .agg(*[F.count(F.when(rule, F.col(id_col))).alias(name) for name, rule in rules.items()])
    )


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def union_with_cutover(historic: DataFrame, current: DataFrame, date_col: str) -> DataFrame:
    """All historic rows plus the current rows of days after the last historic day.

    The cut-over day is a scalar subquery, compared with the bare column so that the
    current feed can be pruned at its scan.
    """
    first_new_day = historic.select(
        F.coalesce(F.date_add(F.max(F.to_date(date_col)), 1), F.lit("0001-01-01").cast("date"))
    ).scalar()
    newer = current.filter(F.col(date_col) >= first_new_day.cast(current.schema[date_col].dataType))
    return historic.unionByName(newer, allowMissingColumns=True)
