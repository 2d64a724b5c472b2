"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every window of `length` bytes has a key: the smallest hash of its shorter grams. Equal
windows have equal keys, so a run of neighbouring windows with one key (a piece) has to be
compared with pieces of the same key only. Keys found once drop out; pieces with equal
bytes are one class, repeated as a whole if it has two members.

The different pieces that remain are dealt to ranges of keys, and within a range to shards.
A shard sorts the suffixes of its pieces and hands on their Burrows-Wheeler transform. The
shards of a range are merged without sorting suffixes again: starting from the shards one
after the other, the interleave is refined by stable steps from a suffix to the suffix two
bytes longer, whose order follows from the transforms alone. Suffixes that share their
first h bytes form a block; a block falls apart where common prefixes end, and a suffix
alone in its block takes no further part. Blocks left at `length` bytes are the repeated
intervals; the transforms, read from the ends of the pieces, tell which windows they hold.

A key with too many different pieces for one range is cut again by keys of longer grams,
at last by whole windows, where equal keys mean equal bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebin.llm.shared import FLUSH_BYTES, scratch, settle

LENGTH = 200
#: Grams of the keys, in parts of the length: a first cut and those for keys with many pieces.
GRAMS = (0.24, 0.66, 1.0)
#: Windows of a text worked on at once, and windows of the longest piece.
WINDOWS = 1 << 20
RUN = 400
#: Bytes of texts in a pack, bytes of pieces in a range, shards of a range.
PACK = 65_536
RANGE = 1 << 19
SHARDS = 4
#: Different pieces with one key that a range takes.
MANY = 4096
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and powers of the base and of its inverse."""
    letters = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return letters, np.cumprod(up), np.cumprod(down)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    m = len(h)
    rows = np.full(-(-m // width) * width, np.uint64(2**64 - 1))
    rows[:m] = h
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: m - width + 1], ahead[width - 1 : m])


def pieces(text: bytes, length: int = LENGTH, gram: int = 48) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (start, windows, key, content, twice): runs of windows with one key, a hash of
    their bytes, and whether two of their windows may be equal."""
    whole = np.frombuffer(text, np.uint8)
    letters, up, down = _powers(WINDOWS + 2 * length)
    for first in range(0, len(whole) - length + 1, WINDOWS):
        part = whole[first : first + WINDOWS + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(letters[part] * up[: len(part)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1]
        h = (h ^ (h >> np.uint64(29))) * MIX
        h ^= h >> np.uint64(32)
        key = _least(h, length - gram + 1)
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[cut, len(key)])
        if size.max() > RUN:
            parts = -(-size // RUN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            cut = np.repeat(cut, parts) + nth * RUN
            size = np.diff(np.r_[cut, len(key)])
        keys = key[cut]
        hit = np.zeros(1 << 16, bool)
        hit[keys & np.uint64(0xFFFF)] = True
        near = np.sort(h[hit[(h & np.uint64(0xFFFF)).astype(np.int64)]])
        twice = np.isin(keys, near[1:][near[1:] == near[:-1]])
        view = memoryview(part)
        stop = cut + size + length - 1
        content = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(cut.tolist(), stop.tolist())), np.uint64, len(cut))
        yield cut + first, size, keys.view(np.int64), content.view(np.int64), twice


def transform(texts: Sequence[bytes]) -> np.ndarray:
    """Burrows-Wheeler transform of the texts, each closed by an end of its own: bytes plus
    one, and 0 where a text begins. Row j < len(texts) is the end of text j."""
    sizes = np.array([len(t) + 1 for t in texts])
    n, ends = int(sizes.sum()), np.cumsum(sizes) - 1
    s = np.zeros(n, np.int64)
    at = np.ones(n, bool)
    at[ends] = False
    s[at] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    value = s + len(texts)
    value[ends] = np.arange(len(texts))
    order = np.argsort(value, kind="stable")
    new = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1]])
    rank = np.empty(n, np.int64)
    width = np.diff(np.r_[new, n])
    rank[order] = np.repeat(new, width)
    left = order[np.repeat(width > 1, width)]
    step = 1
    while len(left):
        held = rank[left]
        both = held * n + rank[left + step]
        order = np.argsort(both, kind="stable")
        left, both, held = left[order], both[order], held[order]
        place = np.arange(len(left))
        group = np.maximum.accumulate(np.where(np.r_[True, held[1:] != held[:-1]], place, 0))
        new = np.r_[True, both[1:] != both[:-1]]
        rank[left] = held + np.maximum.accumulate(np.where(new, place, 0)) - group
        starts = np.flatnonzero(new)
        width = np.diff(np.r_[starts, len(left)])
        left = left[np.repeat(width > 1, width)]
        step *= 2
    out = np.empty(n, np.uint8)
    out[rank] = np.r_[0, s[:-1]]
    return out


def steps_back(bwt: np.ndarray, n_texts: int) -> np.ndarray:
    """For each row, the row of the suffix one byte longer; -1 where a text begins."""
    order = np.argsort(bwt, kind="stable")
    out = np.full(len(bwt), -1, np.int32)
    rest = order[n_texts:]
    out[rest] = n_texts + np.arange(len(rest), dtype=np.int32)
    return out


def merged_blocks(shards: Sequence[tuple[np.ndarray, int]], length: int) -> np.ndarray:
    """Rows, counted through all shards, of the suffixes that share `length` bytes with another.

    `shards`: transforms with their numbers of texts."""
    back, letter, low = [], [], 0
    for bwt, n_texts in shards:
        step = steps_back(bwt, n_texts)
        back.append(np.where(step >= 0, step + low, -1))
        letter.append(bwt)
        low += len(bwt)
    one, letter = np.concatenate(back), np.concatenate(letter).astype(np.uint16)
    two = np.where(one >= 0, one[one], -1).astype(np.int32)
    pair = np.where(two >= 0, (letter[one] << 8) | letter, 0).astype(np.uint16)
    one, order, block = one.astype(np.int32), np.arange(low, dtype=np.int32), np.zeros(low, np.int32)
    for width in [1] * (length % 2) + [2] * (length // 2):
        target, code = (one, letter) if width == 1 else (two, pair)
        signs, order = code[order], target[order]
        goes = np.flatnonzero(order >= 0)
        if not len(goes):
            return order[:0]
        goes = goes[np.argsort(signs[goes], kind="stable")]
        signs, block, order = signs[goes], block[goes], order[goes]
        new = np.ones(len(goes) + 1, bool)
        np.not_equal(signs[1:], signs[:-1], out=new[1:-1])
        new[1:-1] |= block[1:] != block[:-1]
        shared = np.flatnonzero(~(new[:-1] & new[1:]))
        order, block = order[shared], np.cumsum(new[shared], dtype=np.int32)
    return order


def places(bwt: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and offset of each row, by reading all texts from their ends at once."""
    step = steps_back(bwt, len(sizes))
    text, offset = np.empty(len(bwt), np.int64), np.empty(len(bwt), np.int64)
    row, of, at = np.arange(len(sizes)), np.arange(len(sizes)), sizes.astype(np.int64)
    while len(row):
        text[row], offset[row] = of, at
        go = step[row] >= 0
        row, of, at = step[row[go]], of[go], at[go] - 1
    return text, offset


def joined_spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges sorted by start."""
    reach = np.maximum.accumulate(stops)
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[new], reach[np.r_[new[1:] - 1, len(starts) - 1]]


SEGMENTS = "start long, windows int, key long, content long, twice boolean"


def _segments(batches: Iterator[tuple], schema: pa.Schema, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Piece rows of texts given as (kept values, bytes)."""
    out, held = [], 0

    def flushed() -> pa.RecordBatch:
        columns = [pa.array(np.concatenate([np.full(len(p[0]), kept[i]) for kept, p in out]), schema.field(i).type) for i in range(len(out[0][0]))]
        found = [np.concatenate([p[j] for _, p in out]) for j in range(5)]
        return pa.RecordBatch.from_arrays(columns + [pa.array(f, schema.field(len(columns) + j).type) for j, f in enumerate(found)], schema=schema)

    for kept, raw in batches:
        for found in pieces(raw, length, gram):
            out.append((kept, found))
            held += len(found[0])
        if held > 100_000:
            yield flushed()
            out, held = [], 0
    if out:
        yield flushed()


def _packs(df: DataFrame, keep: Sequence[str], text: str, spark: SparkSession) -> DataFrame:
    """Rows packed by about `PACK` bytes, compressed, in a table that is bucketed by `pack`."""
    kept = T.StructType([df.schema[c] for c in keep])
    schema = T.StructType([T.StructField("pack", T.LongType()), T.StructField("rows", T.ArrayType(kept)), *T.StructType.fromDDL("sizes array<long>, texts binary").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipped, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, texts, held, done = [], [], 0, []
            values = [batch.column(i).to_pylist() for i in range(len(keep))]
            for i, value in enumerate(batch.column(len(keep))):
                rows.append({c: v[i] for c, v in zip(keep, values)})
                texts.append((value.as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1]) + 16
                if held >= PACK or i == batch.num_rows - 1:
                    done.append({"pack": number, "rows": rows, "sizes": [len(t) for t in texts], "texts": zipped.compress(b"".join(texts))})
                    rows, texts, held, number = [], [], 0, number + 1
                if len(done) >= 64:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow)
                    done = []
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)

    packed = df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
    path = scratch(spark, "packs")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.repartition(buckets, "pack").write.bucketBy(buckets, "pack").option("path", path).option("compression", "none").saveAsTable(name)
    return spark.table(name)


def _unpacked(row: dict) -> list[bytes]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(row["texts"]), [], 0
    for size in row["sizes"]:
        out.append(raw[at : at + size])
        at += size
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that a batch's large values are not all copied at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _candidates(segments: DataFrame, weight: F.Column) -> tuple[DataFrame, DataFrame]:
    """Pieces whose key is found again, and their classes that are not yet decided: with the
    place of one member, `copies`, and the number `many` of classes with the key."""
    shared = segments.groupBy("key").agg(F.count("*").alias("times"), F.max("twice").alias("self")).filter("times > 1 or self").select("key")
    found = settle(segments.join(shared, "key", "left_semi"))
    place = [c for c in segments.columns if c not in ("key", "content", "twice", "weight")]
    classes = settle(found.groupBy("key", "content").agg(F.sum(weight).alias("copies"), F.min(F.struct(*place)).alias("at"), F.max("twice").alias("twice")))
    of_key = classes.groupBy("key").agg(F.count("*").alias("many"), F.min("copies").alias("fewest"), F.max("twice").alias("self"))
    of_key = of_key.filter("fewest = 1 and (many > 1 or self)").select("key", "many")
    return found, classes.join(of_key, "key", "left").select("key", "content", "copies", "at.*", "many")


def _repeated(found: DataFrame, length: int, spark: SparkSession) -> DataFrame:
    """`key`, `content` and `spans` of the pieces (`raw`, `windows`) that hold repeated windows."""
    total = found.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    ranges = total // RANGE + 1
    dealt = found.select(F.pmod(F.xxhash64("key"), F.lit(ranges)).alias("range"), F.pmod("content", F.lit(SHARDS)).alias("shard"), "key", "content", "windows", "raw")
    made = T.StructType.fromDDL("range long, shard long, bwt binary, keys array<long>, contents array<long>, windows array<int>, sizes array<int>")
    made_arrow = to_arrow_schema(made)

    def shard(part: pa.Table) -> pa.Table:
        texts = part.column("raw").to_pylist()
        row = {c: part.column(c)[0].as_py() for c in ("range", "shard")}
        row |= {"bwt": transform(texts).tobytes(), "keys": part.column("key").to_pylist(), "contents": part.column("content").to_pylist()}
        row |= {"windows": part.column("windows").to_pylist(), "sizes": [len(t) for t in texts]}
        return pa.Table.from_pylist([row], schema=made_arrow)

    out = to_arrow_schema(T.StructType.fromDDL("key long, content long, spans array<struct<lo: long, hi: long>>"))

    def merge(part: pa.Table) -> pa.Table:
        shards = part.sort_by("shard").to_pylist()
        bwts = [np.frombuffer(s["bwt"], np.uint8) for s in shards]
        rows = np.sort(merged_blocks([(b, len(s["sizes"])) for b, s in zip(bwts, shards)], length))
        made, low = [], 0
        for s, bwt in zip(shards, bwts):
            mine = rows[(rows >= low) & (rows < low + len(bwt))] - low
            low += len(bwt)
            if not len(mine):
                continue
            text, offset = (x[mine] for x in places(bwt, np.array(s["sizes"])))
            wide = max(s["sizes"]) + length + 1
            starts = np.sort(text * wide + offset)
            lo, hi = joined_spans(starts, starts + length)
            of, cut = np.unique(lo // wide, return_index=True)
            for k, a, b in zip(of.tolist(), cut.tolist(), [*cut[1:].tolist(), len(lo)]):
                spans = [{"lo": x - k * wide, "hi": y - k * wide} for x, y in zip(lo[a:b].tolist(), hi[a:b].tolist())]
                made.append({"key": s["keys"][k], "content": s["contents"][k], "spans": spans})
        return pa.Table.from_pylist(made, schema=out)

    transforms = dealt.groupBy("range", "shard").applyInArrow(shard, made)
    return transforms.groupBy("range").applyInArrow(merge, "key long, content long, spans array<struct<lo: long, hi: long>>")


def _spans(segments: DataFrame, ids: list[str], raw_of, length: int, level: int, spark: SparkSession) -> DataFrame:
    """`ids`, `lo`, `hi`: ranges of repeated bytes; `raw_of` adds the bytes to undecided classes."""
    weight = F.col("weight") if "weight" in segments.columns else F.lit(1)
    found, classes = _candidates(segments, weight)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.col("windows") + length - 1).cast("long").alias("hi")))
    verdict = classes.filter("copies > 1").select("key", "content", whole.alias("spans"))
    undecided = settle(raw_of(classes.filter("many is not null")))
    many = undecided.filter(F.col("many") > MANY)
    if level + 1 == len(GRAMS) or many.isEmpty():  # whole windows with one key differ in number only
        partly = _repeated(undecided, length, spark)
    else:
        partly = _repeated(undecided.filter(F.col("many") <= MANY), length, spark)
        partly = partly.unionByName(_nested(many, length, level + 1, spark))
    verdict = settle(verdict.unionByName(partly))
    hits = found.join(verdict, ["key", "content"]).select(*ids, "start", F.explode("spans").alias("s"))
    return hits.select(*ids, (F.col("start") + F.col("s.lo")).alias("lo"), (F.col("start") + F.col("s.hi")).alias("hi"))


def _nested(many: DataFrame, length: int, level: int, spark: SparkSession) -> DataFrame:
    """The verdict on pieces of crowded keys, cut by longer grams."""
    schema = T.StructType.fromDDL("of_key long, of_content long, weight long, " + SEGMENTS)
    arrow, gram = to_arrow_schema(schema), max(1, round(GRAMS[level] * length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _segments((((r["key"], r["content"], r["copies"]), r["raw"]) for r in _rows(batches)), arrow, length, gram)

    segments = settle(many.select("key", "content", "copies", "raw").mapInArrow(run, schema))
    whole = many.select(F.col("key").alias("of_key"), F.col("content").alias("of_content"), "raw")

    def raw_of(classes: DataFrame) -> DataFrame:
        part = F.substring("raw", F.col("start").cast("int") + 1, F.col("windows") + length - 1)
        return classes.drop("weight").join(whole, ["of_key", "of_content"]).withColumn("raw", part)

    inner = _spans(segments, ["of_key", "of_content"], raw_of, length, level, spark)
    spans = F.collect_list(F.struct("lo", "hi")).alias("spans")
    return inner.groupBy(F.col("of_key").alias("key"), F.col("of_content").alias("content")).agg(spans)


def without_repeats(df: DataFrame, text: str, keep: Sequence[str], length: int = LENGTH) -> DataFrame:
    """`keep` columns, `n_bytes`, `n_removed`, `removed` (spans of bytes) and `kept` (the other
    bytes) of every row.

    A byte goes if a string of `length` bytes covers it that also starts anywhere else in the
    column, in the same row or another, overlaps included; strings do not cross rows and are
    judged on the input. Null texts are empty; shorter texts stay whole; rows that repeat an
    id or a text are rows of their own. An empty table gives an empty table.
    """
    spark = df.sparkSession
    packs = _packs(df, keep, text, spark)
    schema = T.StructType.fromDDL("pack long, nth long, " + SEGMENTS)
    arrow, gram = to_arrow_schema(schema), max(1, round(GRAMS[0] * length))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (((r["pack"], k), t) for r in _rows(batches) for k, t in enumerate(_unpacked(r)))
        yield from _segments(texts, arrow, length, gram)

    segments = settle(packs.select("pack", "sizes", "texts").mapInArrow(cut, schema))
    sliced = T.StructType.fromDDL("key long, content long, copies long, many long, windows int, raw binary")
    sliced_arrow = to_arrow_schema(sliced)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for row in _rows(batches):
            texts = _unpacked(row)
            for p in row["wanted"]:
                raw = texts[p["nth"]][p["start"] : p["start"] + p["windows"] + length - 1]
                out.append({c: p[c] for c in ("key", "content", "copies", "many", "windows")} | {"raw": raw})
                held += len(raw) + 64
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=sliced_arrow)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=sliced_arrow)

    def raw_of(classes: DataFrame) -> DataFrame:
        wanted = classes.groupBy("pack").agg(F.collect_list(F.struct("nth", "start", "windows", "key", "content", "copies", "many")).alias("wanted"))
        return packs.select("pack", "sizes", "texts").join(wanted, "pack").select("sizes", "texts", "wanted").mapInArrow(slices, sliced)

    hits = _spans(segments, ["pack", "nth"], raw_of, length, 0, spark)
    gone = hits.groupBy("pack").agg(F.collect_list(F.struct("nth", "lo", "hi")).alias("gone"))
    kept = T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL("n_bytes long, n_removed long, removed array<struct<start: long, stop: long>>, kept binary").fields)
    kept_arrow = to_arrow_schema(kept)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for row in _rows(batches):
            ranges: dict[int, list] = {}
            for g in row["gone"] or []:
                ranges.setdefault(g["nth"], []).append((g["lo"], g["hi"]))
            for k, (values, raw) in enumerate(zip(row["rows"], _unpacked(row))):
                spans, left = [], raw
                if k in ranges:
                    lo, hi = joined_spans(*np.array(sorted(ranges[k])).T)
                    spans = [{"start": a, "stop": b} for a, b in zip(lo.tolist(), hi.tolist())]
                    left = b"".join(raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)]))
                out.append(values | {"n_bytes": len(raw), "n_removed": len(raw) - len(left), "removed": spans, "kept": left})
                held += len(left) + 64
                if held >= FLUSH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=kept_arrow)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kept_arrow)

    return packs.join(gone, "pack", "left").select("rows", "sizes", "texts", "gone").mapInArrow(removed, kept)
