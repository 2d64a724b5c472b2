"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebin.llm.shared import discard, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `component` (smallest node reachable) for every node of the edges.

    Each round links larger neighbours to a node's smallest neighbour and then smaller
    ones, by a minimum per node and a join, so no task gathers a node's edges. Rounds end
    when the edges form stars; each is written to the shared folder, so lineage stays
    short. Edges with a null end and loops are ignored; repeated edges count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    e = settle(e.distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = large.join(small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, settle(pointed.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
        now = e.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
