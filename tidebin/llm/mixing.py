"""Mixing sources to target weights: budgets down a tree, then seeded token prefixes.

DataFrame functions only. A token budget goes down a tree of levels (domain, language,
source) by the weights of siblings. What a node cannot fill, even by repeating its texts
`max_epochs` times, goes to its siblings, and only when they are all full to the siblings
of its ancestors. A leaf then takes whole epochs and the token prefix of one more, in an
order drawn from seed, epoch and id.

Prefixes of a large leaf are found in two steps: sums over ranges of the order, about
`RANGE_DOCS` documents each, and single documents only within the range where the budget
ends. No task orders a whole leaf.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebin.llm.shared import settle

RANGE_DOCS = 2000


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weights(nodes: DataFrame, path: Sequence[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """Integer weight of a node; 1 where none is given."""
    given = [(p, w) for p, w in weights.items() if len(p) == len(path)]
    value = F.lit(1)
    for names, weight in given:
        value = F.when(reduce(lambda a, b: a & b, [F.col(c) == n for c, n in zip(path, names)]), weight).otherwise(value)
    return value.cast("long")


def _filled(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Split `parent_budget` among siblings by `weight` up to `room`; adds `budget`.

    Siblings by room for each weight: one is full if its share of what the fuller ones
    leave reaches its room. The others share the rest, rounded down to whole tokens.
    """
    group = Window.partitionBy(*(parent or [F.lit(0)]))
    order = group.orderBy("fill", "node")
    big = "decimal(38,0)"
    rows = nodes.withColumn("room", F.when(F.col("weight") > 0, F.col("room")).otherwise(0))
    rows = rows.withColumn("fill", F.when(F.col("room") > 0, F.col("room") / F.col("weight")).otherwise(F.lit(0.0)))
    before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavier = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    left = F.col("parent_budget") - before
    rows = rows.withColumn("full", F.col("room").cast(big) * heavier <= F.col("weight").cast(big) * left)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(group), F.lit(0))
    sharing = F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)
    exact = F.expr("cast(cast(weight as decimal(19,0)) * cast(parent_budget - taken as decimal(19,0)) div sharing as bigint)")
    rows = rows.withColumn("taken", taken).withColumn("sharing", sharing)
    return rows.withColumn("budget", F.when(F.col("full"), F.col("room")).otherwise(exact))


def budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], budget: int, max_epochs: int
) -> DataFrame:
    """`levels`, `docs`, `tokens` of each leaf with its `budget`."""
    known = leaves.withColumn("room", F.col("tokens") * max_epochs)
    above = None
    for depth in range(1, len(levels) + 1):
        path = list(levels[:depth])
        nodes = known.groupBy(*path).agg(F.sum("room").alias("room"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weights(nodes, path, weights)).withColumn("node", F.col(path[-1]))
        if above is None:
            nodes = nodes.withColumn("parent_budget", F.least(F.lit(budget).cast("long"), F.sum("room").over(Window.partitionBy(F.lit(0)))))
        else:
            nodes = nodes.join(above, path[:-1])
        filled = _filled(nodes, path[:-1])
        above = filled.select(*path, F.col("budget").alias("parent_budget"))
    return filled.select(*levels, "docs", "tokens", "budget")


def _key(seed: int, doc_id: str, epochs: str = "epochs") -> Column:
    """Place of a document in the order of its leaf's unfinished epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epochs, F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def _level(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def mix(
    df: DataFrame,
    doc_id: str,
    levels: Mapping[str, Column],
    tokens: Column,
    weights: Mapping[tuple[str, ...], int],
    share: float = 1.0,
    max_epochs: int = 4,
    seed: int = 0,
) -> DataFrame:
    """One row per document: `doc_id`, the levels, `n_tokens`, `epochs` (whole copies taken)
    and `part_tokens` (taken from the start of one more copy).

    The budget is `share` times all tokens, rounded down. Null level values form a node of
    their own, named by the empty text. Null texts and counts are 0 tokens and take
    nothing. Ids may be null or repeated: each row is a document. An empty table gives none.
    """
    names = list(levels)
    docs = settle(
        df.select(
            F.col(doc_id).alias("doc_id"),
            *[_level(c).alias(n) for n, c in levels.items()],
            F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"),
        )
    )
    leaves = settle(docs.groupBy(*names).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, names, weights, int(total * share), max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long")
    plan = plan.select(
        *[F.col(n).alias(f"leaf_{n}") for n in names],
        whole.alias("epochs"),
        (F.col("budget") - whole * F.col("tokens")).alias("rest"),
        F.greatest(F.lit(1), F.expr(f"docs div {RANGE_DOCS}")).alias("ranges"),
    )
    same = reduce(lambda a, b: a & b, [F.col(n) == F.col(f"leaf_{n}") for n in names])
    placed = docs.join(plan, same).select("doc_id", *names, "n_tokens", "epochs", "rest", "ranges", _key(seed, "doc_id").alias("key"))
    first = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("range", F.shiftright(first * F.col("ranges"), 32)).drop("ranges")
    sums = placed.groupBy(*names, "range").agg(F.sum("n_tokens").alias("in_range"))
    ahead = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)))
    rows = placed.join(sums, [*names, "range"])
    split = (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("in_range") > F.col("rest"))
    within = Window.partitionBy(*names, "range").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.filter(split).withColumn("before", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("before")))
    out = ["doc_id", *names, "n_tokens", "epochs"]
    decided = rows.filter(~split).select(*out, F.when(F.col("ahead") < F.col("rest"), F.col("n_tokens")).otherwise(0).cast("long").alias("part_tokens"))
    return decided.unionByName(cut.select(*out, part.alias("part_tokens")))


def cuts(mixed: DataFrame, levels: Sequence[str], seed: int) -> DataFrame:
    """One row per leaf of a mixture: `__leaf_...` of the levels, `__epochs`, and `__last`, the place of
    the last document that gives part of its tokens (null if none does)."""
    last = F.max(F.when(F.col("part_tokens") > 0, _key(seed, "doc_id"))).alias("__last")
    return mixed.groupBy(*[F.col(n).alias(f"__leaf_{n}") for n in levels]).agg(F.max("epochs").alias("__epochs"), last)


def taken(df: DataFrame, doc_id: str, levels: Mapping[str, Column], tokens: Column, leaf_cuts: DataFrame, seed: int) -> DataFrame:
    """The whole rows of which the mixture takes any token, each once.

    A row is decided by its leaf's cut alone, so only one row per leaf is joined. Rows that
    repeat the id of a taken row and have tokens are taken with it.
    """
    rows = df.withColumns({f"__at_{n}": _level(c) for n, c in levels.items()}).withColumn("__tokens", tokens)
    same = reduce(lambda a, b: a & b, [F.col(f"__at_{n}") == F.col(f"__leaf_{n}") for n in levels])
    part = F.coalesce(_key(seed, doc_id, "__epochs") <= F.col("__last"), F.lit(False))
    chosen = rows.join(leaf_cuts, same).filter((F.col("__tokens") > 0) & ((F.col("__epochs") > 0) | part))
    return chosen.select(*df.columns)
