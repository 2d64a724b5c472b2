"""N-gram Jaccard join by PartEnum signatures.

A text is the set of its distinct word n-grams, as 64-bit hashes. The hash domain is cut
into ranges, more of them for larger sets, and every range that holds elements gives one
signature: a hash of all its elements. Sets of similarity j or more differ in at most
(1-j)/(1+j)*(|x|+|y|) elements, fewer than the smaller set has filled ranges, so they
share a signature; in fact at least `need` of them. Sizes fall into bands from 2^i to
2^(i+1)-1; a set also gives the signatures of the band below if a partner can lie there.
The few sets whose filled ranges are too few share one extra signature for each band.

Signatures found once drop out; sets with fewer than `need` left have no partner; of the
rest, a set keeps its rarest but `need`-1, as in prefix filtering. A passage that many texts
share therefore does not make them candidates. Equal sets are one set from the start.

Within a group of equal signatures, sets are first compared with one pivot. Groups that
still fall into several components go on with all pairs across components, of which only
those are compared that a bitmap does not rule out: each element flips one of 1,024 bits,
so sets whose bitmaps differ in d bits differ in at least d elements. Every pair that might
link two components has then been compared on whole sets or is proven not to link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebin.llm.components import components
from tidebin.llm.shared import discard, few, settle

WORDS = 5
PERCENT = 75
#: Elements for each range at the upper end of a band.
FILL = 2.2
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Words of 64 bits in a bitmap. Beyond about a thousand elements it rules out little.
BITMAP = 16
BITS = [f"b{i}" for i in range(BITMAP)]
#: A set held by more than one of so many rows is hot: there are at most so many of them.
HOT = 1000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words, A-Z lower-cased; fewer words
    than `width` give one n-gram of them all, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total = mixed(total * np.uint64(MIX[0]) + one[j : j + n])
    return np.unique(total)


def max_difference(a: int, b: int, percent: int) -> int:
    return (100 - percent) * (a + b) // (100 + percent)


def signatures(elements: np.ndarray, percent: int = PERCENT, fill: float = FILL) -> list[tuple[int, int, np.ndarray]]:
    """(band, need, signatures) for each band in which a set of this size takes part."""
    n = len(elements)
    if not n:
        return []
    out = []
    band = n.bit_length() - 1
    for level in (band, band - 1):
        top = 2 ** (level + 1) - 1
        if level < band and (level < 0 or -(-percent * n // 100) > top):
            continue
        ranges = 4 * top if top < 64 else int(top / fill) + 1
        place = ((elements >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        sums = np.add.reduceat(mixed(elements + np.uint64(level)), starts)
        found = mixed(sums + mixed(place[starts] * np.uint64(64) + np.uint64(level)))
        partner = 100 * n // percent if level == band else top
        need = len(starts) - max_difference(n, partner, percent)
        if need < 1:
            need, found = 1, np.r_[found, mixed(np.array([level], np.uint64))]
        out.append((level, need, found.view(np.int64)))
    return out


def bitmap(elements: np.ndarray) -> np.ndarray:
    """Bits that an odd number of elements fall on."""
    odd = np.bincount((elements & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def sets(df: DataFrame, doc_id: str, text: str, width: int = WORDS, whole: bool = False) -> DataFrame:
    """`doc` (id), `n` (size), `set_key` (128-bit hash of the set; null if empty) for every
    row, and with `whole` the sorted `elements` and the words `b0`, `b1`, ... of the bitmap."""
    names = ["doc", "n", "set_key", *(["elements", *BITS] if whole else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, rows = 0, 0, []
            for i, value in enumerate(batch.column(1)):
                x = shingles(value.as_py(), width)
                key = xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None
                rows.append((len(x), key, x.view(np.int64), bitmap(x)) if whole else (len(x), key))
                held += x.nbytes
                if held > 8 << 20 or i == batch.num_rows - 1:
                    n, keys, *more = zip(*rows)
                    out = [batch.column(0).slice(start, len(rows)).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary())]
                    if whole:
                        out += [pa.array(more[0], pa.list_(pa.int64())), *[pa.array(w, pa.int64()) for w in np.array(more[1]).T]]
                    yield pa.RecordBatch.from_arrays(out, names=names)
                    start, held, rows = i + 1, 0, []

    schema = "doc long, n long, set_key binary" + (", elements array<long>" + "".join(f", {b} long" for b in BITS) if whole else "")
    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)


def _signature_rows(df: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """`sig`, `doc`, `band` and `need` of every row that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sig", "doc", "band", "need"]

        def packed(parts: list) -> pa.RecordBatch:
            sizes = [len(p[0]) for p in parts]
            rest = [np.repeat(np.array([p[i] for p in parts], kind), sizes) for i, kind in ((1, np.int64), (2, np.int32), (3, np.int32))]
            return _batch([np.concatenate([p[0] for p in parts]), *rest], names)

        for batch in batches:
            parts, held = [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for band, need, found in signatures(shingles(value.as_py(), width), percent):
                    parts.append((found, doc, band, need))
                    held += len(found)
                if held > 100_000:
                    yield packed(parts)
                    parts, held = [], 0
            if parts:
                yield packed(parts)

    rows = df.select(F.col(doc_id).cast("long"), F.col(text)).filter(F.col(doc_id).isNotNull())
    return rows.mapInArrow(run, "sig long, doc long, band int, need int")


def members(df: DataFrame, doc_id: str, text: str, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`sig`, `doc`: the signatures through which a set can have a partner."""
    times = F.count("doc").over(Window.partitionBy("sig"))
    shared = _signature_rows(df, doc_id, text, width, percent).withColumn("times", times).filter("times > 1")
    by_set = shared.groupBy("doc", "band", "need").agg(F.sort_array(F.collect_list(F.struct("times", "sig"))).alias("found"))
    kept = F.slice("found", F.lit(1), F.size("found") - F.col("need") + 1)
    chosen = by_set.filter(F.size("found") >= F.col("need")).select("doc", F.explode(kept).alias("s"))
    return chosen.select("doc", F.col("s.sig").alias("sig")).distinct()


def compared(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (`a`, `b`) with the sizes `n_a`, `n_b` of their whole sets and how many elements are `common`."""

    def side(name: str) -> DataFrame:
        return whole.select(F.col("doc").alias(name), F.col("n").alias(f"n_{name}"), F.col("elements").alias(f"x_{name}"))

    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x_a", "x_b")).cast("long").alias("common"))


def reaches(common: F.Column, sizes: F.Column, percent: int = PERCENT) -> F.Column:
    """Whether sets with so many common elements, of so many together, are similar enough."""
    return 100 * common >= percent * (sizes - common)


def _labelled(found: DataFrame, component: DataFrame) -> DataFrame:
    """The members of signatures that hold several components, with `component`."""
    label = component.select(F.col("node").alias("doc"), "component")
    rows = found.join(label, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    split = rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("sig")
    return rows.join(split, "sig", "left_semi")


def _first_pivots(rows: DataFrame) -> DataFrame:
    """Each member with the smallest one of its group, where their components differ."""
    pivot = F.min(F.struct("doc", "component")).alias("p")
    out = rows.join(rows.groupBy("sig").agg(pivot), "sig").filter("p.component != component")
    return out.select(F.col("p.doc").alias("a"), F.col("doc").alias("b"))


def _usual_pivots(rows: DataFrame) -> DataFrame:
    """One partner for each set: the smallest member of most of its groups."""
    pairs = _first_pivots(rows).groupBy("b", "a").count()
    best = pairs.groupBy("b").agg(F.min(F.struct(-F.col("count"), F.col("a").alias("a"))).alias("m"))
    return best.select("m.a", "b")


def _possible(percent: int) -> F.Column:
    """Whether sets `a` and `b` may link, by their sizes and bitmaps."""
    apart = sum(F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in BITS)
    both = F.col("n_a") + F.col("n_b")
    return reaches(F.least("n_a", "n_b", F.shiftright(both - apart, 1)), both, percent)


def _side(sketch: DataFrame, name: str) -> DataFrame:
    return sketch.select(F.col("doc").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", *BITS)])


def _across(rows: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The pairs across components within a group that may link."""
    left = rows.select("sig", F.col("doc").alias("a"), F.col("component").alias("c")).join(_side(sketch, "a"), "a")
    right = rows.select("sig", F.col("doc").alias("b"), F.col("component").alias("d")).join(_side(sketch, "b"), "b")
    return left.join(right, "sig").filter((F.col("c") < F.col("d")) & _possible(percent)).select("a", "b")


def links(found: DataFrame, whole: DataFrame, edges: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`node`, `component`: components of the sets by `edges` and all links between members."""
    near = reaches(F.col("common"), F.col("n_a") + F.col("n_b"), percent)
    sketch = whole.select("doc", "n", *BITS)
    for pivots in (_usual_pivots, _first_pivots, None):
        component = components(edges)
        rows = settle(_labelled(found, component))
        if rows.isEmpty():
            return component
        if pivots:
            pairs = pivots(rows).distinct().join(_side(sketch, "a"), "a").join(_side(sketch, "b"), "b").filter(_possible(percent))
        else:
            pairs = _across(rows, sketch, percent)
        close = settle(compared(pairs.select("a", "b").distinct(), whole).filter(near).select("a", "b"))
        discard(rows)
        edges = edges.unionByName(close)
    return components(edges)


def join(df: DataFrame, doc_id: str, text: str, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every row as `doc_id`, `n_shingles`, `component_id`: the smallest id reachable by links.

    Two documents link when 100 * intersection >= `percent` * union of their sets. Null and
    empty texts have an empty set, link with nothing and are their own component. An id
    that occurs in several rows is one document, linked through any of them. Rows with a
    null id take no part; their component is null. Other columns play no part.
    """
    sizes = settle(sets(df, doc_id, text, width))
    known = sizes.filter("doc is not null and set_key is not null")
    classes = settle(known.groupBy("set_key").agg(F.min("doc").alias("first"), F.count("doc").alias("copies")))
    texts = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))

    # the ids to leave out, or to look at whole, are few beside the texts, which then stay where they are
    firsts = classes.select(F.col("first").alias("doc")).distinct()
    copies = settle(known.select("doc").distinct().join(firsts, "doc", "left_anti"))
    found = settle(members(texts.join(few(copies), "doc", "left_anti"), "doc", "text", width, percent))
    wanted = settle(found.select("doc").distinct())
    whole = settle(sets(texts.join(few(wanted), "doc", "left_semi"), "doc", "text", width, whole=True))
    again = settle(sizes.filter("doc is not null").groupBy("doc").count().filter("count > 1").select("doc"))
    edges = settle(known.join(again, "doc", "left_semi").join(classes, "set_key").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct())
    component = settle(links(found, whole, edges, percent))
    label = component.select(F.col("node").alias("first"), "component")
    of_set = settle(classes.join(label, "first", "left").select("set_key", "copies", F.coalesce("component", "first").alias("component_id")))
    rows = known.count()
    hot = of_set.filter(F.col("copies") * HOT > rows)
    usual = known.join(F.broadcast(hot), "set_key", "left_anti").join(of_set, "set_key")
    empty = sizes.filter("doc is null or set_key is null").join(component.withColumnRenamed("node", "doc"), "doc", "left")
    out = [F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles")]
    parts = [known.join(F.broadcast(hot), "set_key"), usual, empty.withColumn("component_id", F.coalesce("component", "doc"))]
    every = [p.select(*out, "component_id") for p in parts]
    return every[0].unionByName(every[1]).unionByName(every[2])
