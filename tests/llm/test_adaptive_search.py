import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebin.llm import adaptive_search as A
from tidebin.llm.catalogue import op10_adaptive_search


def plain(rows, is_query, nearest=20):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in good:
        if is_query(q):
            scored = sorted((-float((good[i] * good[q]).sum()), i) for i in good if i != q)[:nearest]
            out[q] = [(i, -s) for s, i in scored]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


def vectors(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dims))
    x = middle[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * rng.choice([0.3, 1.0], size=(n, 1))
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("per_list,block,dims", [(100, 50, 40), (5000, 4096, 40), (60, 4096, 7)])
def test_recall_and_exact_scores(spark, monkeypatch, per_list, block, dims):
    monkeypatch.setattr(A, "LIST_VECTORS", per_list)
    monkeypatch.setattr(A, "BLOCK", block)
    rows = vectors(1500, dims)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, list int, q string").repartition(3)
    got, want = found(A.nearest_neighbours(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0)), plain(rows, lambda i: i % 20 == 0)
    assert recall(got, want) >= 0.9
    data = dict(rows)
    for q, near in got.items():
        assert near == sorted(near, key=lambda r: (-r[1], r[0])) and len(near) == 20
        for i, score in near:
            assert score == pytest.approx(np.dot(data[i], data[q]), rel=1e-12, abs=1e-12)


def skewed():
    """A third of all rows equal, a dense cluster, and groups smaller than what is asked for."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16))
    x[:400] = x[0]
    x[400:1000] = x[400] + 0.05 * rng.normal(size=(600, 16))
    x[1000:] = 3 * x[np.repeat(np.arange(1000, 1020), 10)] + 0.1 * rng.normal(size=(200, 16))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("probes", [1, 2, None])
def test_every_query_gets_its_rows(spark, monkeypatch, probes):
    monkeypatch.setattr(A, "LIST_VECTORS", 20)
    if probes:
        monkeypatch.setattr(A, "lists_to_probe", lambda *a: probes)
    rows = skewed()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = found(A.nearest_neighbours(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0))
    assert set(got) == set(range(0, 1200, 20))
    assert {len(near) for near in got.values()} == {20}


def test_probes_hold_the_recall_of_each_query(spark):
    """Most queries need one list; one has its neighbours in the list that is its second."""
    rng = np.random.default_rng(4)
    x = np.r_[np.array([10.0, 0.0]) + 0.01 * rng.normal(size=(990, 2)), np.array([0.0, 10.0]) + 0.01 * rng.normal(size=(25, 2)), [[0.0, -1.0]]]
    longest = float(np.sqrt((x * x).sum(axis=1)).max())
    centres = A.lengthened(np.array([[10.0, 0.0], [0.0, 10.0], [0.0, -1.0]]), longest)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, vec array<double>")
    queries = rows.filter("vec_id % 10 = 0 or vec_id = 1015").selectExpr("vec_id as query_id", "vec as q")
    assert A.lists_to_probe(rows, queries, centres, longest, 5, 0.97) > 1


def test_ties_and_odd_rows(spark):
    nan = float("nan")
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(30)] + [(40, None), (60, [0.0, 0.0, 0.0]), (80, [nan, 1.0, 0.0]), (100, [1.0, None, 0.0]), (101, []), (None, [5.0, 5.0, 5.0]), (120, [0.5, 0.0, 0.0])]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>")
    got = found(A.nearest_neighbours(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0))
    assert got == plain(rows, lambda i: i % 20 == 0)
    few = found(A.nearest_neighbours(df.filter("vec_id in (0, 3, 120, 40)"), "vec_id", "embedding", F.col("vec_id") % 20 == 0))
    assert few == {0: [(3, 2.0), (120, 0.5)], 120: [(0, 0.5), (3, 0.5)]}
    assert A.nearest_neighbours(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


def test_candidates_are_abandoned_early():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(4000, 127)), rng.normal(size=(4, 127))
    x[:100] = q[0] + 0.1 * rng.normal(size=(100, 127))
    longest = float(np.sqrt((x * x).sum(axis=1)).max())
    turn = A.rotation(128)
    turned, q_turned = A.lengthened(x, longest) @ turn, np.c_[q, np.zeros(4)] @ turn
    full = ((turned[None] - q_turned[:1, None]) ** 2).sum(axis=2)
    bound = np.sort(full, axis=1)[:, 19]
    ids, scores, read = A.scan(np.arange(4000), x, turned, np.array([-1]), q[:1], q_turned[:1], bound)
    assert list(ids[0]) == list(np.lexsort((np.arange(4000), -(x @ q[0])))[:20])
    assert read < 0.5 * 4000 * 128


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = found(op10_adaptive_search(spark, sf_dir)), plain(rows, lambda i: i % 20 == 0)
    assert recall(got, want) >= 0.9
