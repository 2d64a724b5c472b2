"""Session settings and the one place where intermediate tables are written."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidebin")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


#: Rows that a task sorts or joins at most, about.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal `df` out by `keys`, with tasks in proportion to `rows`, so that what one task holds does
    not grow with the table. Spark merges no partitions of a number that is asked for."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > 1 else df


@functools.cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="tidebin-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: `spark.checkpoint.dir`, or the context's checkpoint folder.

    Only a local session that names none, such as a test, gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _test_folder()


def settle(df: DataFrame) -> DataFrame:
    """Write a reduced table once to the shared folder and read it back.

    For interval tables that several operators consume: the raw events are then
    scanned once, a lost executor never forces that scan again, and the written
    size lets Spark choose join strategies from facts.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
