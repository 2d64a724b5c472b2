"""Reading and writing records and interval tables, always with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY_COLUMN = "_row"
_PARTS = (pa.string(), pa.int64(), pa.int32(), pa.string())


def read_interval_csv(spark: SparkSession, path: str, schema: str | T.StructType, *, index: bool = True) -> DataFrame:
    """Header CSV of an interval table, typed by position.

    `schema` names the columns after the unnamed row index, which is dropped. Typing by
    position also copes with headers that repeat a name.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = ([T.StructField(IDENTITY_COLUMN, T.LongType())] if index else []) + list(schema)
    df = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return df.drop(IDENTITY_COLUMN)


def read_object_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Header CSV from an object store (any Hadoop path such as s3a://bucket/key).

    A missing object raises AnalysisException when the plan is built.
    """
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_json_records(
    spark: SparkSession, path: str, schema: str | T.StructType, *, array_file: bool = True
) -> DataFrame:
    """Flat JSON records whose numbers may be quoted, strictly cast to `schema`.

    A file holding one array is a single task per file here; `read_json_array` reads such
    files by many tasks, and `array_file=False` reads JSON lines, which Spark splits.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).option("multiLine", array_file).option("mode", "FAILFAST").json(path)
    return raw.select(*[_strict(F.col(f.name), f) for f in schema])


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files that each hold one JSON array of flat objects, read by many tasks a file.

    Spark cuts the text at closing braces, wherever blocks of the file begin. A brace ends a
    record unless it lies in a string, which the unescaped quotes before it tell: quotes
    are counted for each block, and the blocks that begin within a string are handed to
    all tasks. A record that reaches from one block into others is put together from its
    parts, at most two a block. Values are cast as in `read_json_records`.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    pieces = raw.select(at.alias("at"), "value").select("at.file", "at.start", "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    within = blocks.withColumn("quotes", F.sum("quotes").over(before)).filter("quotes % 2 = 1").select("file", "start", F.lit(True).alias("open"))
    # one row for a block of the files at most: some bytes in a hundred million
    marked = pieces.select("file", "start", "value", (quotes % 2 == 1).alias("odd")).join(F.broadcast(within), ["file", "start"], "left")
    found = marked.select("file", "start", F.coalesce("open", F.lit(False)).alias("open"), "odd", "value")
    parts = found.mapInArrow(_records, "file string, start long, place int, value string")
    whole = parts.filter("place = 1").select("value")
    number = F.sum((F.col("place") == 2).cast("long")).over(Window.partitionBy("file").orderBy("start", "place"))
    cut = parts.filter("place != 1").withColumn("number", number).groupBy("file", "number")
    joined = cut.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "place", "value"))), lambda p: p["value"]), "").alias("value"))
    return parse_json_records(whole.unionByName(joined.select("value")), "value", schema, [])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block in order: those within it (place 1), what continues a record of
    an earlier block (0), and what begins one that goes on in a later block (2)."""
    block, held, place, inside = None, [], 1, False
    for batch in batches:
        out = []
        for file, start, began, odd, value in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, start) != block:
                if held:
                    out.append((*block, 0 if place == 0 else 2, "".join(held)))
                block, held, inside = (file, start), [], began
                place = 0 if began else 1
            if not held and place and not inside:
                value = value[value.find("{") :] if "{" in value else ""
                if not value:
                    continue
            held.append(value + "}")
            inside ^= odd
            if not inside:
                out.append((file, start, place, "".join(held)))
                held, place = [], 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PARTS)], names=["file", "start", "place", "value"])
    if held:
        last = [(*block, 0 if place == 0 else 2, "".join(held))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*last), _PARTS)], names=["file", "start", "place", "value"])


def parse_json_records(df: DataFrame, json_col: str, schema: str | T.StructType, keep: list[str]) -> DataFrame:
    """The same for JSON objects already landed in a text column."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    parsed = df.select(*keep, F.from_json(json_col, text, {"mode": "FAILFAST"}).alias("__j"))
    return parsed.select(*keep, *[_strict(F.col("__j")[f.name], f) for f in schema])


def _strict(value: Column, field: T.StructField) -> Column:
    """ANSI cast: bad text raises; a missing value raises where the field is required."""
    cast = value.cast(field.dataType)
    if not field.nullable:
        cast = F.coalesce(cast, F.raise_error(F.lit(f"missing value for {field.name}")).cast(field.dataType))
    return cast.alias(field.name)


def write_interval_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_interval_csv(df: DataFrame, path: str) -> None:
    """Header CSV; a directory of part files, as written by the tasks."""
    df.write.mode("overwrite").option("header", True).csv(path)
