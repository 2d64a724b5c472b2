"""Exact clusters of many series, against all ways to cut the sorted values."""

import itertools
import math

import numpy as np
import pytest

from tidebin.operators import cluster


def cost(values, cuts):
    """Sum of squares about cluster means, by exact sums."""
    edges = [-math.inf, *cuts, math.inf]
    total = 0.0
    for low, high in itertools.pairwise(edges):
        part = [v for v in values if low < v <= high]
        if part:
            mean = math.fsum(part) / len(part)
            total += math.fsum((v - mean) ** 2 for v in part)
    return total


@pytest.mark.parametrize("k", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", ["whole", "real", "far", "hot"])
def test_split_points_are_the_best_of_all(kind, k):
    rng = np.random.default_rng(k)
    for _ in range(25):
        size = int(rng.integers(1, 13))
        values = np.unique(
            {
                "whole": rng.integers(0, 15, size).astype(float),
                "real": rng.normal(size=size),
                "far": 1e8 + rng.normal(size=size),
                "hot": np.r_[rng.normal(size=size), 50.0],
            }[kind]
        )
        counts = rng.integers(1, 6, len(values)) if kind != "hot" else np.r_[np.ones(len(values) - 1, int), 400]
        every = np.repeat(values, counts)
        got = cluster.split_points(values, counts.astype(float), k)
        assert len(got) == min(k, len(values)) - 1 and list(got) == sorted(set(got))
        best = min(cost(every, c) for c in itertools.combinations(values[:-1], len(got)))
        assert cost(every, got) <= best + 1e-9 * (1 + cost(every, []))


def test_ties_go_to_the_lower_split():
    assert cluster.split_points(np.array([1.0, 2.0, 3.0]), np.ones(3), 2).tolist() == [1.0]


def test_series_are_clustered_apart(spark):
    rng = np.random.default_rng(4)
    data = {f"s{i}": list(rng.normal(i, 1 + i, 40)) + [float(i)] * 5 for i in range(6)}
    rows = [(s, float(v)) for s, values in data.items() for v in values]
    rows += [("s0", None), ("s0", float("nan")), ("s0", float("inf")), (None, 1.0), (None, 5.0), ("few", 2.0), ("few", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "s string, v double")
    got = cluster.kmeans_keyed(df, "v", ["s"], 3).collect()
    assert len(got) == len(rows)
    for s, values in data.items():
        mine = [(r.v, r.cluster) for r in got if r.s == s and r.v is not None and math.isfinite(r.v)]
        cuts = [max(v for v, c in mine if c == label) for label in (2, 1)]
        assert all(c == sum(v <= cut for cut in cuts) for v, c in mine)
        every = sorted(set(values))
        best = min(cost(values, c) for c in itertools.combinations(every[:-1], 2))
        assert cost(values, cuts) == pytest.approx(best, rel=1e-9)
    assert {r.cluster for r in got if r.s == "s0" and (r.v is None or not math.isfinite(r.v))} == {None}
    assert sorted((r.v, r.cluster) for r in got if r.s is None) == [(1.0, 1), (5.0, 0)]
    assert {r.cluster for r in got if r.s == "few"} == {0} and {r.cluster for r in got if r.s == "none"} == {None}


def test_without_keys_it_equals_the_iterated_clusters(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(x),) for x in np.r_[rng.normal(10, 2, 30), rng.normal(30, 4, 50)]], "v double")
    want = sorted((r.v, r.cluster) for r in cluster.kmeans_1d(df, "v").collect())
    assert sorted((r.v, r.cluster) for r in cluster.kmeans_keyed(df, "v", [], 2).collect()) == want


def test_empty_tables_and_wrong_k(spark):
    none = spark.createDataFrame([], "s string, v double")
    assert cluster.kmeans_keyed(none, "v", ["s"], 2).collect() == []
    with pytest.raises(ValueError):
        cluster.kmeans_keyed(none, "v", ["s"], 0)
