"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, and only in local mode, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: With it on, Spark deletes the shuffle files of a query when the query has ended; otherwise they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A table that goes through its steps in slices has so many at most, and so many bytes of file a core at least.
SLICES, SLICE_BYTES = 6, 8 << 20
#: Bytes of a row group in its files, so that all cores share a slice.
BLOCK_BYTES = 4 << 20
#: Where work tables are; those made since passing() began, if it has.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def _write(df: DataFrame, name: str, **options: str) -> str:
    """Write a new table in the shared folder, with no shuffle files left; its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write the table and read it back, so that its lineage ends here."""
    path = _write(df, name)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def _store(spark: SparkSession, path: str):
    """Hadoop's file system of the path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Work tables made inside are deleted at the end; their paths."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            _delete(spark, path)


def drop_table(table: DataFrame) -> None:
    """Delete what work_table has written for this table; nothing may read it any more."""
    _delete(table.sparkSession, _paths.pop(table))


def _slices(spark: SparkSession, path: str, whole: DataFrame, by: list[str]) -> Iterator[tuple[DataFrame, list[str]]]:
    """(rows, files that are done with then) of a table's files, some at a time; a file that is too long comes by a hash of ``by``."""
    store, at = _store(spark, path)
    files = sorted((x.getPath().toString(), x.getLen()) for x in store.listStatus(at) if x.getPath().getName().startswith("part-"))
    most = max(SLICE_BYTES * spark.sparkContext.defaultParallelism, -(-sum(n for _, n in files) // SLICES))
    read = lambda some: spark.read.schema(whole.schema).parquet(*some)
    some, size = [], 0
    for file, n in [*files, ("", most + 1)]:
        if some and size + n > most:
            yield read(some), some
            some, size = [], 0
        if n > most and file:
            parts = -(-n // most)
            for i in range(parts):
                yield read([file]).where(F.pmod(F.xxhash64(*by), F.lit(parts)) == i), [file] if i == parts - 1 else []
        elif file:
            some, size = [*some, file], size + n
    if not files:
        yield whole.limit(0), []


def in_slices(df: DataFrame, by: list[str], name: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``of`` slices of df's rows, one after another, as one table; rows that agree in ``by`` must be one row of df. Work tables that ``of``
    makes are deleted when the slice's result is written, and so are its rows: only one slice's steps are on disk at a time."""
    spark = df.sparkSession
    outer, done = _made.get(), []
    with passing(spark):
        path = _write(df, name, **{"parquet.block.size": str(BLOCK_BYTES)})
        for rows, over in _slices(spark, path, spark.read.schema(df.schema).parquet(path), by):
            with passing(spark) as made:
                found = of(rows)
                done.append(_write(found, name))
                made.pop()
            for file in over:
                _delete(spark, file)
    if outer is not None:
        outer.extend(done)
    return spark.read.schema(found.schema).parquet(*done)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with a running number from 1 inside ``by``, in ``order`` (unique inside ``by``). Rows are dealt to ranges and numbered
    inside their range, and the ranges before are counted, so one value of ``by``, null too, may hold nearly all rows."""
    placed = work_table(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__size"))
    sizes = sizes.select(*by, "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    rows = placed.withColumn("__inside", inside)
    same = [rows[c].eqNullSafe(sizes[c]) for c in by] + [rows["__range"] == sizes["__range"]]
    return rows.join(sizes, same).select(*[rows[c] for c in df.columns], (F.col("__before") + F.col("__inside")).alias(name))
