"""k-means on one measure, with stable cluster numbers.

`kmeans_1d` iterates over one column of any size. `kmeans_keyed` finds the exact clusters of
many series at once: on a line they are runs of sorted values, so prefix sums over
(value, count) and a search for the split points by dynamic programming are enough.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebin.operators.common import attach

#: Costs closer than this share of the total are ties, which go to the lower split.
TIE = 1e-12


def kmeans_1d(
    df: DataFrame,
    col: str,
    k: int = 2,
    *,
    seed: int = 0,
    starts: int = 5,
    parallelism: int = 5,
    max_iter: int = 300,
    out: str = "cluster",
) -> DataFrame:
    """Cluster id per row; ids are renumbered so that 0 has the highest centre.

    Keeps the best of several starts, a few of which run at a time over the one cached
    column. Rows with a null measure get a null cluster.
    """
    features = df.withColumn("__v", array_to_vector(F.array(F.col(col).cast("double"))))
    known = features.filter(F.col(col).isNotNull()).select("__v").persist()

    def fit(i: int) -> KMeansModel:
        return KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=0.0, featuresCol="__v", predictionCol=out).fit(known)

    with ThreadPool(min(parallelism, starts)) as pool:
        fits = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(starts))
    known.unpersist()
    best = min(fits, key=lambda m: m.summary.trainingCost)
    centres = [float(c[0]) for c in best.clusterCenters()]
    # nearest centre written as a column expression: no Python and no model shipped
    ranked = sorted(centres, reverse=True)
    label = F.lit(len(ranked) - 1)
    for i in range(len(ranked) - 2, -1, -1):
        label = F.when(F.col(col) > (ranked[i] + ranked[i + 1]) / 2.0, F.lit(i)).otherwise(label)
    return df.withColumn(out, F.when(F.col(col).isNotNull(), label))


def split_points(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Largest value of each cluster but the highest, for sorted distinct values.

    The sum of squares about cluster means is least over all ways to cut the values in k
    runs. The best last cut does not move left as more values are taken in, so each layer
    halves its range of candidates. With at most k values each is its own cluster.
    """
    m = len(values)
    if m <= k:
        return values[:-1]
    x = values - values[m // 2]  # an actual value: whole numbers stay whole
    n, s, q = (np.concatenate([[0.0], np.cumsum(counts * power)]) for power in (np.ones(m), x, x * x))

    def cost(i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
        return np.maximum(q[j] - q[i] - (s[j] - s[i]) ** 2 / (n[j] - n[i]), 0.0)

    best = np.concatenate([[0.0], cost(0, np.arange(1, m + 1))])
    tie = TIE * best[m]
    cuts = np.zeros((k + 1, m + 1), dtype=int)
    for layer in range(2, k + 1):
        longer = np.full(m + 1, np.inf)
        # only the whole of the values is asked of the last layer
        todo = [(layer if layer < k else m, m, layer - 1, m - 1)]
        while todo:
            low, high, left, right = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            total = best[i] + cost(i, j)
            at = int(np.argmax(total <= total.min() + tie))
            longer[j], cuts[layer, j] = total[at], i[at]
            todo += [(low, j - 1, left, i[at]), (j + 1, high, i[at], right)]
        best = longer
    found, j = [], m
    for layer in range(k, 1, -1):
        j = cuts[layer, j]
        found.append(values[j - 1])
    return np.array(found[::-1])


def kmeans_keyed(df: DataFrame, col: str, keys: Sequence[str], k: int = 2, *, out: str = "cluster") -> DataFrame:
    """Exact clusters of every series; 0 is the one with the highest centre.

    Equal values are counted first, on the map side. The distinct values of one key then meet
    in a task, 16 bytes each, many keys in a batch; that suits interval series, whose length
    is bounded by their calendar. Take `kmeans_1d` for a raw column. Null, NaN and infinite
    measures get a null cluster; a key with fewer than k distinct values has fewer
    clusters; equal costs go to the lower split. `df` is read twice.
    """
    if k < 1:
        raise ValueError(f"at least one cluster is needed, not {k}")

    @F.pandas_udf("array<double>")
    def split(values: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([
            split_points(np.asarray(v, dtype=float), np.asarray(c, dtype=float), k).tolist() for v, c in zip(values, counts)
        ])

    v = F.col(col).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    # adding zero makes negative zero equal to zero
    distinct = df.filter(finite).groupBy(*keys, (v + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    lists = distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("__runs"))
    cuts = lists.select(*keys, split(F.col("__runs")["v"], F.col("__runs")["n"]).alias("__cuts"))
    label = F.size(F.filter("__cuts", lambda c: v <= c))
    return attach(df, cuts, keys).withColumn(out, F.when(finite, label)).drop("__cuts")


def cluster_spans(
    df: DataFrame, col: str, cluster: str = "cluster", start: str = "start_date", end: str = "end_date", keys: Sequence[str] = ()
) -> DataFrame:
    """Size, mean and date span of each cluster, per key if there are any."""
    return df.groupBy(*keys, cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"), F.min(start).alias("first_start"), F.max(end).alias("last_end")
    )
