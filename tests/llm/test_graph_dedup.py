import numpy as np
import pytest

from tidebin.llm import graph_dedup as G
from tidebin.llm.catalogue import op6_embedding_dedup


def plain(rows, threshold=0.98):
    """rows: (id, vector, label). Every pair."""
    good = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and l is not None]
    links, parent = {i: set() for i, *_ in rows if i is not None}, {i: i for i, *_ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    if good:
        x = G.unit(np.array([v for _, v, _ in good]))
        sims = x @ x.T
        for a, b in zip(*np.where(sims >= threshold)):
            i, j = good[a][0], good[b][0]
            if a != b and good[a][2] == good[b][2] and i != j:
                links[i].add(j)
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: (len(links[i]), root(i), root(i) == i) for i in links}


def vectors(seed, n=900, dims=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(n // 3, n):
        x[i] = x[rng.integers(0, 60)] * rng.uniform(0.5, 2) + rng.normal(size=dims) * rng.choice([0, 0.02, 0.1, 0.2])
    return [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("shard", [100, 4000])
def test_recall_against_every_pair(spark, monkeypatch, shard):
    monkeypatch.setattr(G, "SHARD_POINTS", shard)
    rows = vectors(1)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, point string, copies int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in G.near_duplicates(df, "vec_id", "embedding", "label").collect()}
    want = plain(rows)
    assert set(got) == set(want) and sum(w[0] for w in want.values()) > 500
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= (0.97 if shard == 100 else 1) * sum(w[0] for w in want.values())
    if shard == 4000:
        assert got == want


@pytest.mark.parametrize("block", [64, 4096])
def test_group_cut_among_many_shards(spark, monkeypatch, block):
    """A group larger than the shards of a point keeps every link, in one label of several."""
    monkeypatch.setattr(G, "SHARD_POINTS", 40)
    monkeypatch.setattr(G, "BLOCK", block, raising=False)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 24))
    x[:300] = x[0] + 0.1 * rng.normal(size=(300, 24))
    x[300:400] = x[np.repeat(np.arange(400, 450), 2)] + 0.02 * rng.normal(size=(100, 24))
    x[:8] = x[8:16]
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 7 == 0)) for i in map(int, rng.permutation(700))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in G.near_duplicates(df, "vec_id", "embedding", "label").collect()}
    want = plain(rows)
    assert max(w[0] for w in want.values()) > 150
    assert got == want


def test_exact_blocks_when_the_graph_fails(spark, monkeypatch):
    monkeypatch.setattr(G, "search", lambda x, graph, medoid, at, seen, threshold: np.empty(0, np.int64))
    rows = vectors(2, 300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in G.near_duplicates(df, "vec_id", "embedding", "label").collect()}
    assert got == plain(rows)


def test_odd_rows(spark):
    v, nan, inf = [1.0, 2.0, 0.0], float("nan"), float("inf")
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [nan, 1.0, 1.0], 1), (8, [inf, 1.0, 1.0], 1), (9, [1.0, None, 0.0], 1), (10, [], 1), (11, [2.0, 4.0, 0.0], 1), (None, v, 1), (12, [1e300, 2e300, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = G.near_duplicates(df, "vec_id", "embedding", "label").collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id} == plain(rows)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    twice = G.near_duplicates(df.unionByName(df).filter("vec_id in (3, 5)"), "vec_id", "embedding", "label").collect()
    assert len(twice) == 4 and {r.component_id for r in twice} == {3, 5}
    assert G.near_duplicates(df.limit(0), "vec_id", "embedding", "label").count() == 0


def test_search_in_range_of_a_chain():
    """A chain of points each in range of the next: the search stays within range of its own."""
    angles = np.linspace(0, 1.4, 40)
    x = np.c_[np.cos(angles), np.sin(angles)].astype(np.float32)
    graph = G.build(x, 4)
    seen = np.full(40, -1)
    for i in range(40):
        found = set(G.search(x, graph, 20, i, seen, 0.99).tolist())
        assert found == {j for j in range(40) if j != i and x[i] @ x[j] >= 0.99}


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op6_embedding_dedup(spark, sf_dir).collect()}
    assert got == plain(rows)
