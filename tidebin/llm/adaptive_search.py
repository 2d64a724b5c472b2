"""Nearest neighbours by adaptive dimension scans of probed lists.

Vectors get one more dimension that makes all of them equally long, so the largest inner
product is the smallest distance. They are rotated at random and stored in lists by their
nearest centre, each list in blocks of limited size. A query probes its nearest lists. In
a list the rotated columns are read block by block: after each block, the distance so far,
scaled to all dimensions, tests the hypothesis that the candidate is among the nearest;
candidates that fail leave early. The bound comes from the query's few nearest lists,
which are scanned first; of the others only candidates within it are handed on. Survivors are scored on the original
vectors in double precision.

Centres come from at most `SAMPLE` vectors; every vector is in a list. How many lists a
query must probe is measured: for some queries all candidates are searched exactly, and
the smallest number of lists that holds `recall` of the neighbours of each of them is
taken. A query that still has fewer than `nearest` rows searches all other lists too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebin.llm.shared import settle
from tidebin.llm.vectors import matrix, valid

NEAREST = 20
LIST_VECTORS = 1000
MAX_LISTS = 4096
#: Lists that a query scans first, for the bound that the others start with.
FIRST_LISTS = 4
SAMPLE = 50_000
#: Vectors of a list that one task scans together.
BLOCK = 4096
#: Queries that a task compares with a block at a time.
QUERY_ROWS = 256
#: Columns read before each test.
COLUMNS = 16
#: Larger: fewer candidates are abandoned wrongly.
EPSILON = 2.1
AUDIT_QUERIES = 200
RECALL = 0.97
SEED = 7


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """One more column, so that all rows have length `longest`."""
    rest = np.sqrt(np.maximum(0.0, longest * longest - (x * x).sum(axis=1)))
    return np.c_[x, rest]


def centres_of(x: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Plain k-means of a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        n = np.bincount(home, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def order_of_lists(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argsort((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1, kind="stable")


def scan(
    ids: np.ndarray, x: np.ndarray, turned: np.ndarray, query_ids: np.ndarray, q: np.ndarray, q_turned: np.ndarray,
    bound: np.ndarray, nearest: int = NEAREST,
) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each query the ids and scores of its nearest rows within `bound` (squared
    distances), and the number of columns that were read.

    `turned` and `q_turned` are the lengthened and rotated rows.
    """
    dims = turned.shape[1]
    out_ids, out_scores, read = [], [], 0
    for start in range(0, len(q), QUERY_ROWS):
        rows = slice(start, start + QUERY_ROWS)
        limit = np.where(np.isfinite(bound[rows]), bound[rows], np.inf)
        first = min(COLUMNS, dims)
        a, b = q_turned[rows, :first], turned[:, :first]
        so_far = np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T))
        read += so_far.size * first
        alive = query_ids[rows, None] != ids[None]
        alive &= so_far * (dims / first) <= (limit * (1 + EPSILON / first**0.5) ** 2)[:, None]
        for i in range(len(so_far)):
            left = np.flatnonzero(alive[i])
            part = so_far[i, left]
            best, row = limit[i], start + i
            # columns in blocks; who is left after a test is read on
            for at in range(first, dims, COLUMNS):
                end = min(dims, at + COLUMNS)
                step = turned[left, at:end] - q_turned[row, at:end]
                part = part + np.einsum("ij,ij->i", step, step)
                read += step.size
                if end < dims:
                    if len(left) > nearest and not np.isfinite(best):
                        # no bound yet: the nearest so far give one after full distances
                        some = left[np.argpartition(part, nearest - 1)[:nearest]]
                        full = turned[some] - q_turned[row]
                        best = np.einsum("ij,ij->i", full, full).max()
                    keep = part * (dims / end) <= best * (1 + EPSILON / end**0.5) ** 2
                    left, part = left[keep], part[keep]
            # what the bound's list has beaten can't be among the nearest
            inside = part <= limit[i] * (1 + 1e-9) + 1e-12
            left, part = left[inside], part[inside]
            if len(left) > nearest:
                kth = np.partition(part, nearest - 1)[nearest - 1]
                left = left[part <= kth * (1 + 1e-9) + 1e-12]
            scores = (x[left] * q[row]).sum(axis=1)
            best = np.lexsort((ids[left], -scores))[:nearest]
            out_ids.append(ids[left][best])
            out_scores.append(scores[best])
    return out_ids, out_scores, read


def _index(rows: DataFrame, centres: np.ndarray, longest: float) -> DataFrame:
    """`list`, `block`, `vec_id`, `vec` for every vector; blocks are ranges of hashes."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            x = lengthened(matrix(batch.column(1)), longest)
            home = np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *batch.columns], names=["list", "vec_id", "vec"])

    placed = settle(rows.select("vec_id", "vec").mapInArrow(run, "list int, vec_id long, vec array<double>"))
    sizes = placed.groupBy("list").agg(F.ceil(F.count("vec_id") / BLOCK).alias("blocks"))
    return placed.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")


def _probes(queries: DataFrame, centres: np.ndarray, longest: float, first: int, last: int) -> DataFrame:
    """A row for each query and list of rank `first` to `last`-1."""
    sent = queries.sparkSession.sparkContext.broadcast(centres)
    names = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.c_[matrix(batch.column(1)), np.zeros(batch.num_rows)]
            lists = order_of_lists(x, sent.value)[:, first:last].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lists), pa.list_(pa.int32()))], names=[*names, "lists"])

    bound = ", bound double" if "bound" in names else ""
    rows = queries.mapInArrow(run, f"query_id long, q array<double>{bound}, lists array<int>")
    return rows.withColumn("list", F.explode("lists")).drop("lists")


def _searched(index: DataFrame, probes: DataFrame, longest: float, nearest: int) -> DataFrame:
    """`query_id`, `vec_id`, `score`, `bound`: the best of each list block."""
    with_bound = "bound" in probes.columns

    def run(key: tuple, vectors: pa.Table, asked: pa.Table) -> pa.Table:
        found_ids, found_scores, queries = [], [], []
        if len(vectors) and len(asked):
            x, q = matrix(vectors["vec"]), matrix(asked["q"])
            turn = rotation(x.shape[1] + 1)
            turned, q_turned = lengthened(x, longest) @ turn, np.c_[q, np.zeros(len(q))] @ turn
            ids, query_ids = vectors["vec_id"].to_numpy(), asked["query_id"].to_numpy()
            bound = asked["bound"].to_numpy().astype(np.float64) if with_bound else np.full(len(q), np.inf)
            found_ids, found_scores, _ = scan(ids, x, turned, query_ids, q, q_turned, bound, nearest)
            queries = np.repeat(query_ids, [len(f) for f in found_ids])
        cat = lambda parts, kind: np.concatenate(parts) if len(parts) else np.empty(0, kind)
        return pa.table({"query_id": pa.array(queries, pa.int64()), "vec_id": cat(found_ids, np.int64), "score": cat(found_scores, np.float64)})

    blocks = index.select(F.col("list").alias("of_list"), F.col("block").alias("of_block")).distinct()
    asked = probes.join(blocks, F.col("list") == F.col("of_list")).drop("list")
    return index.groupBy("list", "block").cogroup(asked.groupBy("of_list", "of_block")).applyInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)


def lists_to_probe(rows: DataFrame, queries: DataFrame, centres: np.ndarray, longest: float, nearest: int, recall: float) -> int:
    """From exact neighbours of some queries: how many lists hold `recall` of those of each."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(AUDIT_QUERIES).collect()
    if not some or len(centres) == 1:
        return 1
    q = np.array([r.q for r in some])
    ids = np.array([r.query_id for r in some])
    sent = rows.sparkSession.sparkContext.broadcast((q, ids, centres, order_of_lists(np.c_[q, np.zeros(len(q))], centres)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, c, order = sent.value
        ranks = np.argsort(order, axis=1)
        for batch in batches:
            own, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            scores = np.where(ids[:, None] == own[None], -np.inf, q @ x.T)
            home = np.argmin((c * c).sum(axis=1) - 2 * (lengthened(x, longest) @ c.T), axis=1)
            top = min(nearest, len(own))
            best = np.argpartition(-scores, top - 1, axis=1)[:, :top]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, top)), pa.array(own[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel()), pa.array(np.take_along_axis(ranks, home[best], 1).ravel())],
                names=["query_id", "vec_id", "score", "place"],
            )

    exact = rows.select("vec_id", "vec").mapInArrow(run, "query_id long, vec_id long, score double, place long")
    places: dict[int, list[int]] = {}
    for r in _best(exact.filter(F.col("score") > float("-inf")), nearest).select("query_id", "place").collect():
        places.setdefault(r.query_id, []).append(r.place)
    return max((sorted(p)[int(np.ceil(recall * len(p))) - 1] + 1 for p in places.values()), default=1)


def nearest_neighbours(df: DataFrame, vec_id: str, vector: str, is_query: Column, nearest: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """`query_id`, `rank` from 1, `vec_id`, `score` (inner product in double precision) of
    the nearest other rows of each row that `is_query` holds for, ties by smaller id.

    Vectors that are null, empty, zero, hold null or non-finite parts or differ in length
    from most take no part, nor do rows with a null id. Rows that repeat an id and its
    vector count once. With fewer candidates than `nearest`, all are returned.
    """
    spark = df.sparkSession
    rows = settle(valid(df.withColumn("__query", F.coalesce(is_query, F.lit(False))), vec_id, vector, "__query").dropDuplicates(["vec_id"]))
    about = rows.agg(F.count("vec_id").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)).alias("longest")).first()
    if not about.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = float(about.longest) ** 0.5
    sample = np.array([r.vec for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()])
    lists = max(1, min(MAX_LISTS, len(sample), -(-about.n // LIST_VECTORS)))
    # equal centres are one list: all but the first of them would get no vector
    centres = np.unique(centres_of(lengthened(sample, longest), lists), axis=0)
    queries = rows.filter("__query").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    probes = lists_to_probe(rows, queries, centres, longest, nearest, recall)
    index = settle(_index(rows, centres, longest))
    first = settle(_best(_searched(index, _probes(queries, centres, longest, 0, min(FIRST_LISTS, probes)), longest, nearest), nearest))
    # the distance of the last of `nearest` found in the first lists bounds the others
    ends = first.filter(F.col("rank") == nearest).select(F.col("query_id").alias("end_id"), F.col("score").alias("end"))
    q2 = F.aggregate("q", F.lit(0.0), lambda a, v: a + v * v)
    distance = F.greatest(F.lit(0.0), q2 + longest * longest - 2 * F.col("end")) * (1 + 1e-9) + 1e-12
    bound = F.when(F.col("end").isNotNull(), distance).otherwise(F.lit(float("inf")))
    bounded = queries.join(ends, F.col("query_id") == F.col("end_id"), "left").select("query_id", "q", bound.alias("bound"))
    more = _searched(index, _probes(bounded, centres, longest, FIRST_LISTS, probes), longest, nearest) if probes > FIRST_LISTS else None
    found = first.select("query_id", "vec_id", "score")
    best = _best(found if more is None else found.unionByName(more), nearest)
    if probes < len(centres):
        best = settle(best.select("query_id", "vec_id", "score", "rank"))
        full = best.filter(F.col("rank") == nearest).select(F.col("query_id").alias("full_id"))
        short = settle(queries.join(full, F.col("query_id") == F.col("full_id"), "left_anti"))
        if not short.isEmpty():
            rest = _searched(index, _probes(short, centres, longest, probes, len(centres)), longest, nearest)
            best = _best(best.drop("rank").unionByName(rest), nearest)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
