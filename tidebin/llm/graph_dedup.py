"""Near-duplicate vectors by robust-pruned flat graphs on overlapping shards.

Vectors are compared within their label. Identical vectors become one point first. Each
point goes to the shards of its `overlap` nearest centres. In a shard a flat graph is
built: a point keeps a short list of near points, none of which is clearly nearer to
another kept one (robust pruning). The lists that a point has in its shards are united.
With them, every point is searched for in each of its shards: greedily from the shard's
medoid, then expanding from everything found in range until nothing new is. Candidates
are verified in double precision.

Each shard audits its search against exact comparison for some of its points, and one
that misses links is compared exactly, block by block.

Links between points that share no shard are found exactly, without an audit. A point in
range of `p` whose nearest centre is B lies on B's side of the plane between B and any
other centre, so `p` is within the range of that plane. A point is compared, block by
block, with the points nearest to each centre for which this holds and that is none of
its own shards. On vectors without clusters that is a large part of the centres, and the
work grows with the square of a label; for a group of near copies it is all of them.

No pair leaves a task: a pair is counted in the first shard that its points share, and
what leaves is a number of links for each point and one tree edge for each further point
of a group. Centres are at most `CENTRES` for each label; a shard then holds about
`SHARD_POINTS` points while labels have up to CENTRES * SHARD_POINTS / 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebin.llm.components import components
from tidebin.llm.shared import settle
from tidebin.llm.vectors import matrix, unit, valid

SIMILAR = 0.98
SHARD_POINTS = 4000
CENTRES = 1024
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
BEAM = 8
#: Differences of 1 - cosine that are rounding in single precision.
NOISE = 1e-5
#: Shards of a point.
OVERLAP = 2
#: Points on either side that a task compares when it looks for links between shards.
BLOCK = 4096
#: Points of a shard whose exact links the audit compares.
AUDIT_SHARD = 48
RECALL = 0.99
#: The search widens over points up to this many times as far (in 1 - cosine) as the threshold:
#: a pruned neighbour is reached through one that may lie outside the range itself.
WIDE = 3.0
#: Slack of the search, so that rounding in single precision loses no candidate.
SLACK = 0.01


def build(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Robust-pruned lists of one shard, and up to as many edges back: row i has neighbours
    of i, padded with i."""
    n = len(x)
    width = min(CANDIDATES, n - 1)
    out = np.repeat(np.arange(n)[:, None], degree, axis=1)
    if width < 1:
        return out
    for start in range(0, n, 512):
        rows = np.arange(start, min(n, start + 512))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -2
        found = np.argpartition(-near, width - 1, axis=1)[:, :width] if width < n - 1 else np.argsort(-near, axis=1)[:, :width]
        sims = np.take_along_axis(near, found, axis=1)
        order = np.argsort(-sims, axis=1)
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        between = np.einsum("ijd,ikd->ijk", x[found], x[found], optimize=True)
        alive = np.ones(found.shape, bool)
        every = np.arange(len(rows))
        for k in range(min(degree, width)):
            some = alive.any(axis=1)
            pick = np.argmax(alive, axis=1)
            out[rows[some], k] = found[every, pick][some]
            # a candidate goes if a kept point is ALPHA times nearer to it than the point itself
            alive &= ~(ALPHA * ALPHA * (1 - between[every, pick]) <= 1 - sims - NOISE)
            alive[every, pick] = False
    tails, heads = np.repeat(np.arange(n), degree), out.ravel()
    order = np.argsort(heads, kind="stable")
    tails, heads = tails[order], heads[order]
    place = np.arange(len(heads)) - np.searchsorted(heads, heads)
    back = np.repeat(np.arange(n)[:, None], degree, axis=1)
    room = place < degree
    back[heads[room], place[room]] = tails[room]
    return np.concatenate([out, back], axis=1)


def search(x: np.ndarray, graph: np.ndarray, medoid: int, at: int, seen: np.ndarray, threshold: float) -> np.ndarray:
    """Points in range of point `at`: greedy from the medoid and its own list, then widening."""
    q, wide = x[at], 1 - WIDE * (1 - threshold)
    fresh = np.unique(np.r_[medoid, graph[at]])
    seen[fresh] = at
    ids, sims = [], []
    best = -2.0
    while len(fresh):
        s = x[fresh] @ q
        ids.append(fresh), sims.append(s)
        inside = fresh[s >= wide]
        if len(inside):
            expand = inside
        elif s.max() > best:
            expand = fresh[np.argsort(-s)[:BEAM]]
        else:
            break
        best = max(best, s.max())
        fresh = np.unique(graph[expand])
        fresh = fresh[seen[fresh] != at]
        seen[fresh] = at
    ids, sims = np.concatenate(ids), np.concatenate(sims)
    return ids[(sims >= threshold) & (ids != at)]


def _graph_rows(points: DataFrame) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        x = unit(matrix(group["vec"])).astype(np.float32)
        ids = group["point"].to_numpy()
        lists = ids[build(x)]
        return pa.table({"point": pa.array(ids), "near": pa.array(list(lists), pa.list_(pa.int64()))})

    lists = points.groupBy("label", "shard").applyInArrow(run, "point long, near array<long>")
    return lists.groupBy("point").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _search_rows(points: DataFrame, threshold: float) -> DataFrame:
    """`point`, `links` (vectors of other points in range, counted in this shard), `root`."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, copies = group["point"].to_numpy(), group["copies"].to_numpy()
        shard = group["shard"][0].as_py()
        exact = unit(matrix(group["vec"]))
        x = exact.astype(np.float32)
        n = len(ids)
        order = np.argsort(ids)
        near = group["near"].to_pylist()
        width = max(map(len, near))
        graph = np.repeat(np.arange(n)[:, None], width, axis=1)
        for i, found in enumerate(near):
            at = np.minimum(np.searchsorted(ids, found, sorter=order), n - 1)
            local = order[at]
            local = local[ids[local] == found]
            graph[i, : len(local)] = local
        middle = x.mean(axis=0)
        medoid = int(np.argmax(x @ middle))
        homes = group["homes"].to_pylist()
        # shards of a point before this one: a pair that shares one of them is counted there
        earlier = [{h for h in found if h < shard} for found in homes]
        mixed = np.array([bool(e) for e in earlier])
        seen = np.full(n, -1)
        links, parent = np.zeros(n, np.int64), np.arange(n)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def take(i: int, found: np.ndarray) -> None:
            found = found[exact[found] @ exact[i] >= threshold]
            for j in found[found < i]:
                a, b = root(i), root(int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if mixed[i] and mixed[found].any():
                found = np.array([j for j in found if not earlier[i] & earlier[j]], np.int64)
            links[i] = copies[found].sum() if len(found) else 0

        lost = total = 0
        for i in np.linspace(0, n - 1, min(n, AUDIT_SHARD)).astype(int):
            want = np.flatnonzero(exact @ exact[i] >= threshold)
            got = search(x, graph, medoid, i, seen, threshold - SLACK)
            lost += len(np.setdiff1d(want, np.r_[got, i]))
            total += len(want)
        seen[:] = -1
        if lost > (1 - RECALL) * total:
            for start in range(0, n, 256):
                block = x[start : start + 256] @ x.T
                for i in range(start, min(n, start + 256)):
                    found = np.flatnonzero(block[i - start] >= threshold - SLACK)
                    take(i, found[found != i])
        else:
            for i in range(n):
                take(i, search(x, graph, medoid, i, seen, threshold - SLACK))
        roots = np.array([root(i) for i in range(n)])
        smallest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(smallest, roots, ids)
        return pa.table({"point": ids, "links": links, "root": smallest[roots]})

    return points.groupBy("label", "shard").applyInArrow(run, "point long, links long, root long")


def _centres(points: DataFrame) -> dict[object, np.ndarray]:
    """Points chosen by hash as centres: one for each half shard, at most CENTRES a label."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("point"), "point"))
    sizes = points.groupBy("label").agg(F.count("point").alias("n"))
    few = F.least(F.lit(CENTRES), F.ceil(F.col("n") * 2 / SHARD_POINTS))
    # only the smallest hashes of a label can be centres, so the rank is taken over few rows
    share = F.least(F.lit(1.0), 4 * (few + 20) / F.col("n"))
    low = (F.pmod(F.xxhash64("point"), F.lit(1 << 30)) / float(1 << 30)) < share
    some = points.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "label").filter(low)
    chosen = some.withColumn("rank", rank).filter(F.col("rank") <= few).select("label", "vec").collect()
    out: dict[object, list] = {}
    for r in chosen:
        out.setdefault(r.label, []).append(r.vec)
    return {label: unit(np.array(rows)) for label, rows in out.items()}


def _placed(points: DataFrame, centres: dict[object, np.ndarray], overlap: int, threshold: float) -> DataFrame:
    """Every point with its nearest shard in `first`, all its shards in `homes`, and in
    `others` those whose nearest points may be in range of it though it is not in them."""
    sent = points.sparkSession.sparkContext.broadcast(centres)
    schema = f"label {points.schema['label'].dataType.simpleString()}, point long, copies long, vec array<double>, first int, homes array<int>, others array<int>"
    far = (2 * (1 - threshold)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((1, 1))
        gaps: dict[object, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            x = unit(matrix(batch.column(3)))
            first = np.zeros(len(labels), np.int32)
            homes: list = [None] * len(labels)
            others: list = [np.empty(0, np.int32)] * len(labels)
            for label in set(labels):
                rows = np.array([i for i, v in enumerate(labels) if v == label])
                c = sent.value.get(label, none)
                if len(c) == 1:
                    best = np.zeros((len(rows), 1), int)
                else:
                    sims = x[rows] @ c.T
                    best = np.argsort(-sims, axis=1)[:, :overlap]
                    if label not in gaps:
                        gaps[label] = np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T)))
                    near = np.ones(sims.shape, bool)
                    for own in best.T:
                        near &= np.take_along_axis(sims, own[:, None], 1) - sims <= far * gaps[label][own] + NOISE
                    np.put_along_axis(near, best, False, axis=1)
                    for i, b in zip(rows, near):
                        others[i] = np.flatnonzero(b).astype(np.int32)
                first[rows] = best[:, 0]
                for i, b in zip(rows, best):
                    homes[i] = np.sort(b).astype(np.int32)
            lists = [pa.array(v, pa.list_(pa.int32())) for v in (homes, others)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(first), *lists], names=["label", "point", "copies", "vec", "first", "homes", "others"])

    return points.select("label", "point", "copies", "vec").mapInArrow(run, schema)


def _between_rows(placed: DataFrame, threshold: float) -> DataFrame:
    """`point`, `links` (vectors of points in range that share no shard with it), `root`."""

    def run(key: tuple, asking: pa.Table, asked: pa.Table) -> pa.Table:
        ids = np.r_[asking["point"].to_numpy(), asked["of_point"].to_numpy()]
        n = len(asking)
        links, roots = np.zeros(len(ids), np.int64), ids.copy()
        if n and len(asked):
            x, y = unit(matrix(asking["vec"])), unit(matrix(asked["of_vec"]))
            copies = asked["of_copies"].to_numpy()
            mine, theirs = (matrix(c).astype(int) for c in (asking["homes"], asked["of_homes"]))
            for start in range(0, n, 256):
                close = x[start : start + 256] @ y.T >= threshold
                for i in np.flatnonzero(close.any(axis=1)):
                    row, found = start + i, np.flatnonzero(close[i])
                    met = np.unique(np.r_[roots[row], roots[n + found]])
                    if len(met) > 1:
                        roots[np.isin(roots, met)] = met[0]
                    apart = ~(theirs[found][:, :, None] == mine[row]).any(axis=(1, 2))
                    links[row] = copies[found[apart]].sum()
        some = np.flatnonzero((links > 0) | (roots != ids))
        return pa.table({"point": ids[some], "links": links[some], "root": roots[some]})

    about = ["point", "copies", "vec", "homes"]
    asking = placed.select("label", F.explode("others").alias("shard"), *about)
    asked = placed.select("label", F.col("first").alias("shard"), *about)
    blocks = asked.groupBy("label", "shard").agg(F.ceil(F.count("point") / BLOCK).cast("int").alias("blocks"))
    parts = asking.groupBy("label", "shard").agg(F.ceil(F.count("point") / BLOCK).cast("int").alias("parts"))
    sizes = settle(blocks.join(parts, ["label", "shard"]))

    def one(count: str) -> F.Column:
        return F.pmod(F.xxhash64("point"), F.col(count)).cast("int")

    def each(count: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    names = ["label", "shard", "block", "part"]
    left = asking.join(sizes, ["label", "shard"]).withColumn("part", one("parts")).withColumn("block", each("blocks"))
    right = asked.join(sizes, ["label", "shard"]).withColumn("block", one("blocks")).withColumn("part", each("parts"))
    left, right = left.select(*names, *about), right.select([F.col(c).alias(f"of_{c}") for c in names + about])
    return left.groupBy(*names).cogroup(right.groupBy([f"of_{c}" for c in names])).applyInArrow(run, "point long, links long, root long")


def near_duplicates(df: DataFrame, vec_id: str, vector: str, label: str, threshold: float = SIMILAR) -> DataFrame:
    """`vec_id`, `n_links`, `component_id`, `kept` for every row.

    Vectors that are null, zero, hold null or non-finite parts, have no label or differ in
    length from most link with nothing and are kept. Rows that repeat an id must repeat
    its vector. Rows with a null id have no link and a null component.
    """
    rows = valid(df, vec_id, vector, F.col(label).alias("label")).filter("label is not null")
    same = rows.groupBy("label", "vec").agg(F.min("vec_id").alias("point"), F.count("vec_id").alias("copies"))
    points = settle(same)
    centres = _centres(points)
    placed = settle(_placed(points, centres, OVERLAP, threshold))
    shards = placed.select("*", F.explode("homes").alias("shard"))
    united = _graph_rows(shards)
    searched = settle(_search_rows(shards.join(united, "point"), threshold))
    if any(len(c) > OVERLAP for c in centres.values()):
        searched = searched.unionByName(settle(_between_rows(placed, threshold)))
    links = settle(searched.groupBy("point").agg(F.sum("links").alias("links")))
    groups = components(searched.select(F.col("point").alias("a"), F.col("root").alias("b")))
    of_point = points.join(links, "point").join(groups, F.col("point") == F.col("node"), "left")
    of_point = of_point.select("label", "vec", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "point").alias("component"))
    mine = rows.join(of_point, ["label", "vec"]).select(F.col("vec_id").alias("__id"), "n_links", "component").distinct()
    out = df.select(F.col(vec_id).cast("long").alias("vec_id")).join(mine, F.col("vec_id") == F.col("__id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
