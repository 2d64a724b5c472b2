"""Token counts by a separator scan over flat token files.

A token file is a flat run of little-endian token ids without an index; a reserved id ends
each document. Files are read as blocks. Each block is searched for the separator with one
vectorised comparison, which gives the document ends inside it; a document's tokens may
begin blocks before. A prefix scan over the blocks of a file (documents ended so far, and
position of the last end) stitches the blocks together: sums over groups of blocks first,
so no task orders all blocks of a large file.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebin.llm.shared import settle

TOKEN_TYPE = "<u4"
BLOCK_TOKENS = 1 << 16
#: Blocks whose sums make one row of the upper level of the prefix scan.
GROUP_BLOCKS = 1024


def write_tokens(
    df: DataFrame, text: str, vocab_path: str, pattern: str, separator: int, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Token files from texts, as a settled table of blocks: `file`, `block`, `data`.

    Each task writes one file: the ids of its texts one after the other, each text followed
    by the separator, cut into blocks of `block_tokens`. The files hold no document ids or
    offsets. Null and empty texts give a lone separator.
    """
    with open(vocab_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encode = tiktoken.Encoding("tokens", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        end = np.array([separator], TOKEN_TYPE)
        held, size, at = [], 0, 0
        for batch in batches:
            for value in batch.column(0):
                held += [np.array(encode(value.as_py() or ""), TOKEN_TYPE), end]
                size += len(held[-2]) + 1
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    cut = size - size % block_tokens
                    for start in range(0, cut, block_tokens):
                        yield one(at, flat[start : start + block_tokens])
                        at += 1
                    held, size = [flat[cut:]], size - cut
        if size:
            yield one(at, np.concatenate(held))

    def one(at: int, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([ids.tobytes()], pa.binary())], names=["block", "data"])

    blocks = df.select(text).mapInArrow(run, "block long, data binary")
    return settle(blocks.select(F.spark_partition_id().cast("string").alias("file"), "block", "data"))


def read_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of the flat files below `path`, each at most 2 GB (the limit of one value)."""
    width = np.dtype(TOKEN_TYPE).itemsize
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    starts = F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(block_tokens * width))
    cut = files.select(F.col("path").alias("file"), "content", F.posexplode(starts).alias("block", "start"))
    data = F.expr(f"substring(content, start + 1, {block_tokens * width})")
    return cut.select("file", F.col("block").cast("long").alias("block"), data.alias("data"))


def block_ends(blocks: DataFrame, separator: int) -> DataFrame:
    """`file`, `block`, `size` and `ends`: positions of separators within each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for data in batch.column(2):
                raw = data.as_py() or b""
                ids = np.frombuffer(raw[: len(raw) - len(raw) % 4], TOKEN_TYPE)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == separator))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "size", "ends"]
            )

    return blocks.select("file", "block", "data").mapInArrow(run, "file string, block long, size long, ends array<long>")


def document_tokens(blocks: DataFrame, separator: int) -> DataFrame:
    """`file`, `document` (from 0 within the file), `first_token`, `n_tokens` (without the separator), `closed`.

    Ids after a file's last separator are a document with `closed` false; a file that ends
    in a separator has none. Empty files give no row; trailing bytes that make no whole id
    are ignored. Blocks must be numbered from 0 without gaps; rows with a null file are
    one file.
    """
    found = settle(block_ends(blocks, separator))
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    sums = found.select(
        F.coalesce("file", F.lit("")).alias("f"), "block", F.floor(F.col("block") / GROUP_BLOCKS).alias("g"), "size", F.size("ends").cast("long").alias("n"), last.alias("last")
    )
    before = Window.partitionBy("f", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # within a group: tokens and documents before the block, and the last end before it
    inner = sums.withColumn("t0", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("d0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inner = inner.withColumn("end", F.col("t0") + F.col("last")).withColumn("e0", F.max("end").over(before))
    groups = inner.groupBy("f", "g").agg(F.sum("size").alias("gt"), F.sum("n").alias("gd"), F.max("end").alias("ge"))
    ahead = Window.partitionBy("f").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("gt0", F.coalesce(F.sum("gt").over(ahead), F.lit(0))).withColumn("gd0", F.coalesce(F.sum("gd").over(ahead), F.lit(0)))
    groups = groups.withColumn("ge0", F.max(F.col("gt0") + F.col("ge")).over(ahead))
    placed = inner.join(groups.select("f", "g", "gt0", "gd0", "ge0"), ["f", "g"]).select(
        "f",
        F.col("block").alias("b"),
        (F.col("gt0") + F.col("t0")).alias("tokens_before"),
        (F.col("gd0") + F.col("d0")).alias("documents_before"),
        F.coalesce(F.col("gt0") + F.col("e0"), "ge0", F.lit(-1)).alias("end_before"),
    )
    same = (F.coalesce("file", F.lit("")) == F.col("f")) & (F.col("block") == F.col("b"))
    both = found.join(placed, same)
    places = F.transform("ends", lambda e: e + F.col("tokens_before"))
    each = both.select("f", "documents_before", F.concat(F.array("end_before"), places).alias("at"), F.posexplode(places).alias("i", "end"))
    closed = each.select(
        F.col("f").alias("file"),
        (F.col("documents_before") + F.col("i")).alias("document"),
        (F.get("at", F.col("i")) + 1).alias("first_token"),
        (F.col("end") - F.get("at", F.col("i")) - 1).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    whole = groups.groupBy("f").agg(F.sum("gt").alias("tokens"), F.sum("gd").alias("documents"), F.coalesce(F.max(F.col("gt0") + F.col("ge")), F.lit(-1)).alias("end"))
    rest = whole.filter("end < tokens - 1").select(
        F.col("f").alias("file"), F.col("documents").alias("document"), (F.col("end") + 1).alias("first_token"), (F.col("tokens") - F.col("end") - 1).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(rest)
