"""Rolling-origin folds, and the moments of their training windows.

Where folds overlap much, no row is copied into each of them. The ends of all windows of one length cut a series into cells: at most two for each step,
none of which a window holds in part. Rows are reduced to one set of moments a cell, on the
map side. Borders are then drawn as many cells apart as a window has, so every window is
the end of one stretch and the start of the next: two running sums that meet at a border.
Both are taken about the same centre, a mean beside the border, which lies in every window
that they serve. Nothing is subtracted from a longer sum, so no digits cancel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebin.operators.common import attach
from tidebin.operators.moments import moment_columns

#: Up to so many copies of a row, folding it directly is cheaper than two running sums.
DIRECT = 8
#: What a row of the reduced table is: cells left and right of a border, and test parts.
LEFT, CELL, RIGHT, TEST = -1, 0, 1, 2


def series_spans(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """First position of each series and the positions it spans, gaps included."""
    span = F.max(pos) - F.min(pos) + 1
    return df.groupBy(*keys).agg(F.min(pos).alias("__p0"), span.alias("__n"))


def rolling_origin_folds(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    *,
    train: int,
    horizon: int,
    step: int,
    spans: DataFrame | None = None,
) -> DataFrame:
    """Add `fold`, `role` ("train" or "test") and `step_ahead` (1.. in the test part).

    Fold f trains on positions `f*step .. f*step+train-1` counted from the series' first and
    tests on the next `horizon`. Only whole folds are made; a row appears once per fold it
    belongs to. `spans` (see `series_spans`) may be given where the rows are costly to
    compute twice.
    """
    stats = series_spans(df, keys, pos) if spans is None else spans
    q = F.col(pos) - F.col("__p0")
    newest = F.least(F.floor((F.col("__n") - train - horizon) / F.lit(step)), F.floor(q / F.lit(step)))
    oldest = F.greatest(F.lit(0), F.floor((q - train - horizon) / F.lit(step)) + 1)
    rows = attach(df, stats, keys).withColumns({"__q": q, "__hi": newest, "__lo": oldest})
    inside = rows.filter(F.col("__lo") <= F.col("__hi")).withColumn("fold", F.explode(F.sequence("__lo", "__hi")))
    offset = F.col("__q") - F.col("fold") * step
    return (
        inside.withColumn("role", F.when(offset < train, "train").otherwise("test"))
        .withColumn("step_ahead", F.when(offset >= train, offset - train + 1))
        .withColumn("fold_row", offset)
        .drop("__p0", "__n", "__q", "__hi", "__lo")
    )


def _geometry(d: Column, warm_up: int, train: int, step: int) -> tuple[Column, Column, Column]:
    """Length of a window, cells a step, cells a window; all depend on the differencing."""
    length = F.greatest(F.lit(train - warm_up) - d, F.lit(0))
    even = F.pmod(length, F.lit(step)) == 0
    a_step = F.when(even, 1).otherwise(2)
    a_window = F.floor(length / F.lit(step)) * a_step + F.when(even, 0).otherwise(1)
    return length, a_step, a_window


def _reduced(rows, keys, pos, cols, known, spans, warm_up, train, horizon, step) -> DataFrame:
    """One row for each cell with its moments, and one for each test part with its rows."""
    newest = F.floor((F.col("__n") - train - horizon) / F.lit(step))
    placed = attach(rows, spans, keys).withColumns({"__q": F.col(pos) - F.col("__p0"), "__newest": newest})
    wide = placed.filter("__newest >= 0").select(*keys, "__q", "__newest", "__y", "__levels", F.inline("__designs"))
    q, d = F.col("__q"), F.col("d")
    length, a_step, a_window = _geometry(d, warm_up, train, step)
    u = q - warm_up - d
    late = (a_step == 2) & (F.pmod(u, F.lit(step)) >= F.pmod(length, F.lit(step)))
    cell = F.floor(u / F.lit(step)) * a_step + F.when(late, 1).otherwise(0)
    inside = (u >= 0) & (length > 0) & (cell < F.col("__newest") * a_step + a_window)
    oldest = F.greatest(F.lit(0), F.floor((q - train - horizon) / F.lit(step)) + 1)
    youngest = F.least(F.col("__newest"), F.floor((q - train + 1) / F.lit(step)))
    none = F.array().cast("array<struct<side:int,at:bigint>>")
    of_cell = F.array(F.struct(F.lit(CELL).alias("side"), cell.cast("bigint").alias("at")))
    of_test = F.transform(
        F.sequence(oldest, youngest), lambda f: F.struct(F.lit(TEST).alias("side"), f.cast("bigint").alias("at"))
    )
    units = F.concat(F.when(inside, of_cell).otherwise(none), F.when((q >= train - 1) & (oldest <= youngest), of_test).otherwise(none))
    entries = wide.select(*keys, "d", *cols, "__q", "__newest", "__y", "__levels", F.inline(units))
    complete = F.col("side") == CELL
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    x = [F.when(complete, F.col(c)) for c in cols]
    fold_row = F.when(F.col("side") == TEST, F.col("__q") - F.col("at") * step)
    tests = F.collect_list(F.when(fold_row >= train, F.struct(fold_row.alias("fold_row"), *known)))
    return entries.groupBy(*keys, "d", "side", "at").agg(
        *moment_columns(x),
        F.array(*[F.max(c) for c in x]).alias("top"),
        F.max("__newest").alias("newest"),
        F.first(F.when(fold_row == train - 1, F.col("__levels")), True).alias("levels"),
        F.array_sort(tests).alias("tests"),
    )


def _copied(rows, keys, pos, cols, known, spans, warm_up, train, horizon, step) -> DataFrame:
    """Each row folded directly: one aggregate, combined on the map side."""
    folded = rolling_origin_folds(rows, keys, pos, train=train, horizon=horizon, step=step, spans=spans)
    wide = folded.select(*keys, "fold", "role", "fold_row", "__y", "__levels", F.inline("__designs"))
    fits = (F.col("role") == "train") & (F.col("fold_row") >= warm_up + F.col("d"))
    tests = F.collect_list(F.when(F.col("role") == "test", F.struct("fold_row", *known)))
    return wide.groupBy(*keys, "fold", "d").agg(
        *moment_columns([F.col(c) for c in cols], fits),
        F.first(F.when(F.col("fold_row") == train - 1, F.col("__levels")), True).alias("levels"),
        F.array_sort(tests).alias("tests"),
    )


def fold_moments(
    rows: DataFrame,
    keys: Sequence[str],
    pos: str,
    cols: Sequence[str],
    known: Sequence[Column],
    spans: DataFrame,
    *,
    warm_up: int,
    train: int,
    horizon: int,
    step: int,
    direct: int = DIRECT,
) -> DataFrame:
    """`keys`, `fold`, `d`, `n`, `mean`, `cov`, `levels`, `tests` for each fold and d.

    `rows` holds `__y`, `__levels` and `__designs`, an array of structs of `d` and `cols`. Fold
    f trains on positions `f*step + warm_up + d .. f*step + train - 1` from the first, where
    no column is null; `levels` are those of its last training position, `tests` its test rows
    as structs of `fold_row` and `known`, in order. Folds without any row have no result.
    Beyond `direct` folds a row, a training row is moved once, within the moments of its cell,
    however many folds hold it, and a test row once for each fold that tests it.
    """
    shape = (rows, keys, pos, cols, known, spans, warm_up, train, horizon, step)
    return _copied(*shape) if train <= direct * step else _shared(*shape)


def _shared(rows, keys, pos, cols, known, spans, warm_up, train, horizon, step) -> DataFrame:
    """Two running sums a fold, over cells."""
    k = len(cols)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    reduced = _reduced(rows, keys, pos, cols, known, spans, warm_up, train, horizon, step)
    _, a_step, a_window = _geometry(F.col("d"), warm_up, train, step)
    w = F.greatest(a_window, F.lit(1))
    block = F.floor(F.col("at") / w)
    unit = lambda side, border, away: F.struct(F.lit(side).alias("half"), border.alias("border"), away.alias("away"))
    beside = F.array(
        unit(RIGHT, block, F.col("at") - block * w), unit(LEFT, block + 1, (block + 1) * w - 1 - F.col("at"))
    )
    alone = F.array(unit(TEST, F.col("at"), F.lit(0).cast("bigint")))
    halves = reduced.select("*", F.inline(F.when(F.col("side") == CELL, beside).otherwise(alone)))

    # a column that does not vary in a cell has its value as the exact mean
    exact = [F.when(F.col("cov")[i * k + i] == 0, F.col("top")[i]).otherwise(F.col("mean")[i]) for i in range(k)]
    near = Window.partitionBy(*keys, "d", "border").orderBy("away", "half")
    halves = halves.withColumn("mean", F.when(F.col("n") > 0, F.array(*exact)))
    halves = halves.withColumn("centre", F.first("mean", True).over(near))
    off = [F.col("mean")[i] - F.col("centre")[i] for i in range(k)]
    sums = {f"s{i}": F.col("n") * off[i] for i in range(k)}
    sums |= {f"s{i}_{j}": F.col("n") * (F.col("cov")[i * k + j] + off[i] * off[j]) for i, j in upper}
    halves = halves.withColumns({name: F.coalesce(F.when(F.col("n") > 0, c), F.lit(0.0)) for name, c in sums.items()})

    outwards = Window.partitionBy(*keys, "d", "border", "half").orderBy("away")
    so_far = outwards.rowsBetween(Window.unboundedPreceding, 0)
    run = halves.withColumns(
        {"__next": F.lead("at").over(outwards)} | {c: F.sum(c).over(so_far) for c in ["n", *sums]}
    )
    # a running sum serves the folds that end, or start, from its cell to the next one with rows
    at, border, following = F.col("at"), F.col("border"), F.col("__next")
    ends = F.coalesce(following - 1, (border + 1) * w - 1)
    starts = F.coalesce(following + 1, (border - 1) * w + 1)
    is_left, is_right = F.col("half") == LEFT, F.col("half") == RIGHT
    lowest = F.when(is_right, F.ceil((at + 1 - w) / a_step)).when(is_left, F.ceil(starts / a_step)).otherwise(at)
    highest = F.when(is_right, F.floor((ends + 1 - w) / a_step)).when(is_left, F.floor(at / a_step)).otherwise(at)
    run = run.withColumns({"__lo": F.greatest(lowest, F.lit(0)), "__hi": F.least(highest, F.col("newest"))})
    parts = run.filter("__lo <= __hi").withColumn("fold", F.explode(F.sequence("__lo", "__hi")))
    whole = parts.groupBy(*keys, "fold", "d").agg(
        *[F.sum(c).alias(c) for c in ["n", *sums]],
        F.first(F.when(F.col("half") != TEST, F.col("centre")), True).alias("centre"),
        F.max_by("levels", "half").alias("levels"),
        F.max_by("tests", "half").alias("tests"),
    )
    n = F.nullif(F.col("n"), F.lit(0))
    shift = [F.col(f"s{i}") / n for i in range(k)]
    cov = {(i, j): F.col(f"s{i}_{j}") / n - shift[i] * shift[j] for i, j in upper}
    return whole.select(
        *keys, "fold", "d", "n", "levels", "tests",
        F.array(*[F.col("centre")[i] + shift[i] for i in range(k)]).alias("mean"),
        F.array(*[cov[min(i, j), max(i, j)] for i in range(k) for j in range(k)]).alias("cov"),
    )
