"""Reproducible row numbers in a pseudo-random or sorted order, without a global sort
in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebin.operators.common import attach

BUCKET_DIGITS = 3  # 4096 buckets, ordered like the hash itself


def shuffle_key(ids: Sequence[str], seed: int | Column) -> Column:
    """md5 of seed and row identity: the same order in every run, also after a task is
    repeated, and reproducible outside Spark."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", seed.cast("string"), *[F.col(c).cast("string") for c in ids]))


def with_random_index(
    df: DataFrame, ids: Sequence[str], seed: int | Column, keys: Sequence[str] = (), out: str = "shuffled"
) -> DataFrame:
    """Number the rows 0.. per key in md5 order. `ids` must identify a row within its key.

    Rows are spread over hash ranges and numbered inside each; the counts of the earlier
    ranges (at most 4096 per key) give the offsets.
    """
    hashed = df.withColumn("__h", shuffle_key(ids, seed)).withColumn("__b", F.substring("__h", 1, BUCKET_DIGITS))
    order = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
        .select(
            *[F.col(k).alias(f"__key_{k}") for k in keys],
            F.col("__b").alias("__b2"),
            F.coalesce(F.sum("__c").over(order), F.lit(0)).alias("__before"),
        )
    )
    same = F.col("__b") == F.col("__b2")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", *ids))
    return (
        hashed.withColumn("__r", inside)
        .join(offsets, same)
        .withColumn(out, F.col("__before") + F.col("__r") - 1)
        .select(*df.columns, out)
    )


#: Rows that the last hash range of a share should hold.
RANGE_ROWS = 64


def random_share(
    df: DataFrame, ids: Sequence[str], seed: int | Column, share: float, keys: Sequence[str] = (), out: str = "chosen"
) -> DataFrame:
    """Flag exactly `ceil(share * n)` rows of each key: those with the smallest md5, then ids.

    The row at that rank is found by selection. Counts of hash ranges, about the square root
    of a key's rows of them, tell the range that holds the rank; counts of ranges within it
    tell the next; only its rows are ordered. Every other row is decided by comparison with
    the row found, so no row is numbered or joined with another row.
    """
    found = attach(df.withColumn("__h", shuffle_key(ids, seed)), _share_sizes(df, share, keys), keys)
    digits = F.col("__digits")
    ahead, kept = F.col("__rank"), found
    for level in (0, 1):
        part = F.col("__h").substr(digits * level + 1, digits)
        counts = kept.groupBy(*keys, part.alias("__part")).agg(F.count(F.lit(1)).alias("__c"), F.first(ahead).alias("__r"))
        before = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__c")
        holds = counts.withColumn("__b", before).filter((F.col("__b") < F.col("__r")) & (F.col("__r") <= F.col("__b") + F.col("__c")))
        holds = holds.select(*keys, F.col("__part").alias(f"__part{level}"), (F.col("__r") - F.col("__b")).alias(f"__left{level}"))
        kept = attach(kept, holds, keys, "inner").filter(part == F.col(f"__part{level}"))
        ahead = F.col(f"__left{level}")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__h", *ids))
    last = kept.withColumn("__place", place).filter(F.col("__place") == ahead)
    last = last.select(*keys, F.struct(F.col("__h").alias("h"), *[F.col(c).alias(f"i{i}") for i, c in enumerate(ids)]).alias("__last"))
    mine = F.struct(shuffle_key(ids, seed).alias("h"), *[F.col(c).alias(f"i{i}") for i, c in enumerate(ids)])
    return attach(df, last, keys).withColumn(out, F.coalesce(mine <= F.col("__last"), F.lit(False))).drop("__last")


def _share_sizes(df: DataFrame, share: float, keys: Sequence[str]) -> DataFrame:
    """For each key the rank of the last row, and the hexadecimal digits of a range."""
    n = F.count(F.lit(1))
    ranges = F.greatest(n / RANGE_ROWS, F.lit(1))
    digits = F.ceil(F.log(16.0, ranges) / 2).cast("int")
    return df.groupBy(*keys).agg(F.ceil(n * F.lit(share)).alias("__rank"), digits.alias("__digits"))


def first_rows(df: DataFrame, n: int, by: str | Column) -> DataFrame:
    """The n rows that come first by a column: a distributed top-k, not a full sort."""
    return df.orderBy(by).limit(n)


def last_rows(df: DataFrame, n: int, by: str) -> DataFrame:
    return df.orderBy(F.desc(by)).limit(n)


def ranked(df: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """Rows by descending value, optionally only the top n; nulls last."""
    order = df.orderBy(F.col(by).desc_nulls_last())
    return order if n is None else order.limit(n)
