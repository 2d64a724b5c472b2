"""Filling missing values of an evenly spaced series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebin.operators.common import BLOCK, BLOCK_ROWS, block_of
from tidebin.session import spread


def interpolate_linear(
    df: DataFrame, keys: Sequence[str], pos: str, col: str, size: int = BLOCK_ROWS
) -> DataFrame:
    """Linear in position between neighbours; the edges copy the nearest value.

    Works block by block. The nearest known value outside a block comes from a
    summary with one row per block, so no task ever holds a whole series. Blocks are dealt
    to tasks in proportion to the rows. The table is counted and read twice: pass a settled one.
    """
    known = F.col(col).isNotNull()
    rows = df.withColumns(
        {BLOCK: block_of(pos, size), "__v": F.col(col).cast("double"), "__p": F.when(known, F.col(pos))}
    )

    # both directions scan forward: a frame that ends at "unbounded following" is quadratic
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        rows.groupBy(*keys, BLOCK)
        .agg(
            F.max("__p").alias("p1"), F.max_by("__v", "__p").alias("v1"),
            F.min("__p").alias("p0"), F.min_by("__v", "__p").alias("v0"),
        )
        .select(
            *[F.col(k).alias(f"__key_{k}") for k in keys],
            F.col(BLOCK).alias("__b"),
            F.last("p1", True).over(earlier).alias("__before_p"),
            F.last("v1", True).over(earlier).alias("__before_v"),
            F.last("p0", True).over(later).alias("__after_p"),
            F.last("v0", True).over(later).alias("__after_v"),
        )
    )
    same = F.col(BLOCK) == F.col("__b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    rows = spread(rows, df.count(), *keys, BLOCK).join(edges, same, "left")

    block = Window.partitionBy(*keys, BLOCK)
    upward = block.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    downward = block.orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    near = {}
    for c in ("p", "v"):
        near[f"__lo_{c}"] = F.coalesce(F.last(f"__{c}", True).over(upward), F.col(f"__before_{c}"))
        near[f"__hi_{c}"] = F.coalesce(F.last(f"__{c}", True).over(downward), F.col(f"__after_{c}"))
    filled = rows.withColumns(near)
    p0, v0, p1, v1 = (F.col(f"__{c}") for c in ("lo_p", "lo_v", "hi_p", "hi_v"))
    slope = (v1 - v0) / F.nullif(p1 - p0, F.lit(0))
    value = F.coalesce(F.col("__v"), v0 + slope * (F.col(pos) - p0), v0, v1)
    return filled.withColumn(col, value).select(*df.columns)
