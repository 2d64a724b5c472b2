"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebin.session import settle, shared_folder  # noqa: F401

#: Bytes of result a task gathers before it hands a batch back to Spark.
FLUSH_BYTES = 8 << 20
#: Ids that are sent to all tasks at once (8 bytes each); more are joined by a shuffle.
SENT_IDS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo `folds`; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    text: str,
    added: T.StructType,
    make: Callable[[], Callable[[str], tuple]],
    weigh: Callable[[tuple], int] = lambda row: 64,
) -> DataFrame:
    """Apply a per-text function in Arrow batches: `keep` columns plus `added`.

    `make` runs once per task and returns the function from a text (null: empty)
    to the values of `added`. A task holds one input batch and at most FLUSH_BYTES
    of results.
    """
    fields = [df.schema[c] for c in keep] + list(added.fields)
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        n_keep = len(keep)
        for batch in batches:
            start, held, rows = 0, 0, []
            for i, value in enumerate(batch.column(n_keep)):
                row = one(value.as_py() or "")
                rows.append(row)
                held += weigh(row)
                if held >= FLUSH_BYTES:
                    yield _pack(batch, start, rows, n_keep, arrow)
                    start, held, rows = i + 1, 0, []
            if rows:
                yield _pack(batch, start, rows, n_keep, arrow)

    return df.select(*[F.col(c) for c in keep], F.col(text).alias("__text")).mapInArrow(run, schema)


def _pack(batch: pa.RecordBatch, start: int, rows: list, n_keep: int, schema: pa.Schema) -> pa.RecordBatch:
    part = batch.slice(start, len(rows))
    kept = [part.column(i).cast(schema.field(i).type) for i in range(n_keep)]
    made = [pa.array(list(col), type=schema.field(n_keep + j).type) for j, col in enumerate(zip(*rows))]
    return pa.RecordBatch.from_arrays(kept + made, schema=schema)


def few(ids: DataFrame) -> DataFrame:
    """A settled table of one id column, to be sent to all tasks if it holds few rows, so that
    what it is joined with need not move."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more."""
    for df in tables:
        for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("settled-"):
                jvm = df.sparkSession._jvm
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
