"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null as empty; qualified, so that other columns cannot shadow it."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset, and only in local mode, a temporary folder is made and remembered.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Rows of texts or shingle sets that go to a Python worker at once: some MB, where the usual 10,000 rows are many times as much.
BATCH_ROWS = 2048


#: With it on, Spark deletes the shuffle files of a query when the query has ended; otherwise they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def for_writing(spark: SparkSession) -> Iterator[None]:
    """Inside, jobs send at most BATCH_ROWS rows a batch to Python workers and leave no shuffle files; the session's settings
    come back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, cleanup = spark.conf.get(key), spark.conf.get(CLEANUP, "false")
    rows = int(before)
    spark.conf.set(key, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
        spark.conf.set(CLEANUP, cleanup)


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table into the shared folder and read it back: lineage ends here, a lost
    executor costs a re-read, not a recomputation, and the shuffle files that led here are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with for_writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """At the end of a task: give what its Python worker no longer holds back to the machine; workers are reused."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
