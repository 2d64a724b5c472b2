"""Exact quantiles of groups of any size by distributed selection.

`percentile` and `median` hold all values of a group in one buffer. Here a sketch brackets
each quantile, two counts tell how many values lie below the bracket and up to its end, and
only the values inside are ordered, as (value, count) after combining on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebin.operators.common import attach
from tidebin.session import settle

#: A bracket holds about four in this many of a group's values.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = (), *, accuracy: int = ACCURACY) -> DataFrame:
    """`keys`, `share`, `quantile`: the values at ranks `share * (n - 1)` from 0, between two
    ranks in proportion, as `percentile` gives them.

    Nulls do not count, NaN is larger than all numbers, and a group without values gives
    null. The sketch only decides how many values are looked at: a bracket that the counts
    show to miss its ranks is replaced by the whole range of the group. What is found for
    each group is settled, so Spark sends few groups to the rows and a large one is not
    gathered by its key.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    ends = [min(max(s + side * 2 / accuracy, 0.0), 1.0) for s in shares for side in (-1, 1)]
    stats = settle(rows.groupBy(*keys).agg(
        F.count("__v").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile_approx("__v", ends, accuracy).alias("__ends"),
    ))
    v = F.col("__v")
    parts = range(len(shares))
    lo, hi = ([F.get("__ends", F.lit(2 * i + side)) for i in parts] for side in (0, 1))
    counts = [F.count(F.when(v < lo[i], 1)).alias(f"__below{i}") for i in parts]
    counts += [F.count(F.when(v <= hi[i], 1)).alias(f"__upto{i}") for i in parts]
    counted = attach(rows, stats, keys).groupBy(*keys).agg(*counts)
    rank = [F.col("__n").cast("double") - 1 for _ in parts]
    rank = [F.lit(float(s)) * r for s, r in zip(shares, rank)]
    brackets = []
    for i, s in enumerate(shares):
        holds = (F.col(f"__below{i}") <= F.floor(rank[i])) & (F.ceil(rank[i]) < F.col(f"__upto{i}"))
        brackets.append(
            F.struct(
                F.lit(float(s)).alias("share"), F.when(holds, lo[i]).otherwise(F.col("__min")).alias("lo"),
                F.when(holds, hi[i]).otherwise(F.col("__max")).alias("hi"),
                F.when(holds, F.col(f"__below{i}")).otherwise(0).alias("before"), rank[i].alias("rank"),
            )
        )
    placed = settle(attach(stats, counted, keys).select(*keys, F.array(*brackets).alias("__b")))
    inside = attach(rows.filter(v.isNotNull()), placed, keys)
    inside = inside.select(*keys, "__v", F.explode(F.filter("__b", lambda b: (v >= b["lo"]) & (v <= b["hi"]))).alias("__s"))
    share = [*keys, "__s"]
    tally = inside.groupBy(*share, "__v").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.col("__s.before") + F.sum("__c").over(Window.partitionBy(*share).orderBy("__v"))
    tally = tally.withColumn("__upto", upto)
    at = F.col("__s.rank")
    first, second = (F.min(F.when(F.col("__upto") > r, v)).alias(n) for r, n in ((F.floor(at), "__x"), (F.ceil(at), "__y")))
    found = tally.groupBy(*share).agg(first, second)
    part = at - F.floor(at)
    between = F.when((part == 0) | F.col("__x").eqNullSafe(F.col("__y")), F.col("__x")).otherwise((1 - part) * F.col("__x") + part * F.col("__y"))
    found = found.select(*keys, F.col("__s.share").alias("share"), between.alias("quantile"))
    wanted = stats.select(*keys, F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    return attach(wanted, found, [*keys, "share"])
