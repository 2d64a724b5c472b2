"""Gaussian kernel density estimates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebin.operators.common import attach

CHUNK_ROWS = 512  # rows x grid points held at once


def _partial_sums(keys: Sequence[str], gridsize: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per batch and key, the summed kernel at every grid point: one row of `gridsize` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.arange(gridsize)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for k in keys:
                encoded = pc.dictionary_encode(batch.column(k), null_encoding="encode")
                _, code = np.unique(
                    code * len(encoded.dictionary) + encoded.indices.to_numpy(zero_copy_only=False), return_inverse=True
                )
            order = np.argsort(code, kind="stable")
            code = code[order]
            z, g, w = (batch.column(c).to_numpy(zero_copy_only=False)[order] for c in ("__z", "__g", "__w"))
            sums = np.zeros((int(code[-1]) + 1, gridsize))
            for at in range(0, len(code), CHUNK_ROWS):
                part = slice(at, at + CHUNK_ROWS)
                u = z[part, None] + g[part, None] * points
                kernel = np.exp(-0.5 * u * u) * w[part, None]
                first = np.flatnonzero(np.r_[True, np.diff(code[part]) != 0])
                sums[code[part][first]] += np.add.reduceat(kernel, first, axis=0)
            rows = pa.array(order[np.flatnonzero(np.r_[True, np.diff(code) != 0])])
            lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, gridsize, dtype=np.int32), sums.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(rows) for k in keys] + [lists], names=[*keys, "__sums"]
            )

    return run


def kde(
    df: DataFrame, col: str, keys: Sequence[str] = (), *, gridsize: int = 200, cut: float = 3.0, count_equal: bool = False
) -> DataFrame:
    """Density on an even grid over `[min - cut*h, max + cut*h]`, Scott bandwidth
    `h = s * n^(-1/5)`, per key.

    Tasks evaluate the kernel on Arrow batches and emit one row of partial sums per batch
    and key; Spark adds these up, so no data rows are shuffled. `count_equal` first counts
    equal values, which costs a shuffle and pays off where values repeat a lot. Keys with
    fewer than two values or no spread give no rows.
    """
    y = F.col(col).cast("double")
    values = df.filter(y.isNotNull()).select(*keys, y.alias("__y"), F.lit(1.0).alias("__w"))
    stats = (
        values.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp("__y").alias("__s"), F.min("__y").alias("__lo"), F.max("__y").alias("__hi"))
        .withColumn("bandwidth", F.col("__s") * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
        .select(
            *keys, "__n", "bandwidth",
            (F.col("__lo") - cut * F.col("bandwidth")).alias("__from"),
            ((F.col("__hi") - F.col("__lo") + 2 * cut * F.col("bandwidth")) / F.lit(float(gridsize - 1))).alias("__step"),
        )
    )
    if count_equal:
        values = values.groupBy(*keys, "__y").agg(F.sum("__w").alias("__w"))
    rows = attach(values, stats, keys).filter(F.col("bandwidth") > 0)
    scaled = rows.select(
        *keys,
        ((F.col("__from") - F.col("__y")) / F.col("bandwidth")).alias("__z"),
        (F.col("__step") / F.col("bandwidth")).alias("__g"),
        "__w",
    )
    fields = [df.schema[k] for k in keys] + [T.StructField("__sums", T.ArrayType(T.DoubleType()))]
    partial = scaled.mapInArrow(_partial_sums(list(keys), gridsize), T.StructType(fields))
    sums = (
        partial.select(*keys, F.posexplode("__sums").alias("grid", "__k"))
        .groupBy(*keys, "grid").agg(F.sum("__k").alias("__k"))
    )
    x = F.col("__from") + F.col("grid") * F.col("__step")
    scale = F.col("__n") * F.col("bandwidth") * F.lit(math.sqrt(2 * math.pi))
    return attach(sums, stats, keys).select(
        *keys, "grid", x.alias("x"), (F.col("__k") / scale).alias("density"), "bandwidth"
    )
