"""Two building blocks shared by the series operators.

`attach` adds per-key statistics to rows. `blocks` cuts long series into short
overlapping runs so that ordered work never needs a whole series in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "__block"
BLOCK_ROWS = 4096


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Add the columns of `stats` (one row per key) to every row of `df`.

    With keys this is an equi-join without hint: Spark broadcasts the small side
    only when its size allows, and the adaptive skew join splits a hot key.
    Without keys `stats` is one aggregate row and becomes a scalar subquery.
    """
    names = [c for c in stats.columns if c not in keys]
    if not keys:
        packed = stats.select(F.struct(*names).alias("s")).scalar()
        return df.select("*", *[packed[n].alias(n) for n in names])
    right = stats.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *names)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return df.join(right, same, how).drop(*[f"__key_{k}" for k in keys])


def block_of(pos: Column | str, size: int = BLOCK_ROWS) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(size))


def to_blocks(
    df: DataFrame,
    pos: str,
    before: int | Column = 0,
    after: int | Column = 0,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Copy each row to its own block and to neighbours that need it as a margin.

    A row serves blocks holding positions `pos-after .. pos+before`; only rows near
    a block edge are copied, so the overhead is (before+after)/size.
    """
    first, last = block_of(F.col(pos) - after, size), block_of(F.col(pos) + before, size)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last)))


def block_window(keys: Sequence[str], pos: str) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(pos)


def own_rows(df: DataFrame, pos: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Drop the margin copies again."""
    return df.filter(F.col(BLOCK) == block_of(pos, size)).drop(BLOCK)


def with_lags(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    lags: dict[str, tuple[str, int]],
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Add shifted columns `{name: (column, offset)}`; positive offsets look back.

    `pos` holds integers, unique per key. A shifted value is that of the position exactly
    `offset` away: where a series has a gap it is null, whatever the block size.
    """
    back = max([k for _, k in lags.values()] + [0])
    ahead = max([-k for _, k in lags.values()] + [0])
    w = block_window(keys, pos)
    shifted = {name: F.first(c).over(w.rangeBetween(-k, -k)) for name, (c, k) in lags.items()}
    return own_rows(to_blocks(df, pos, back, ahead, size).withColumns(shifted), pos, size)
