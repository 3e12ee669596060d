"""A mirror table that batches change in part.

Rows are dealt to buckets by a hash of their key. A batch rewrites only the buckets that hold one of its rows, below a
folder of its own, and is committed by a manifest that names for each bucket the batch whose files are live. Readers
follow the last manifest. A batch that died before its manifest has changed nothing that can be seen, and one that runs again
writes the same.

    data/batch=7/bucket=12/*.parquet     manifests/batch=7/*.parquet: (bucket, batch, buckets)
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["scope_id", "page_id"]
MANIFEST = "bucket int, batch long, buckets int"
BUCKETS = 64


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket")


class Store:
    """The folder's file system, as Spark sees it."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.root = spark, directory.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self, folder: str, name: str) -> list[int]:
        """The numbers of the subfolders ``name``=<number>, sorted."""
        at = self.path(f"{self.root}/{folder}")
        if not self.fs.exists(at):
            return []
        found = (re.fullmatch(rf"{name}=(-?\d+)", x.getPath().getName()) for x in self.fs.listStatus(at))
        return sorted(int(m[1]) for m in found if m)

    def committed(self) -> list[int]:
        return [n for n in self.numbers("manifests", "batch") if self.fs.exists(self.path(f"{self.root}/manifests/batch={n}/_SUCCESS"))]

    def remove(self, folder: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{folder}"), True)


def live_files(spark: SparkSession, directory: str, before: int | None = None) -> tuple[dict[int, int], int | None]:
    """({bucket: batch whose files are live}, number of buckets), of the last batch (below ``before``) that was committed."""
    found = [n for n in Store(spark, directory).committed() if before is None or n < before]
    if not found:
        return {}, None
    rows = spark.read.schema(MANIFEST).parquet(f"{directory.rstrip('/')}/manifests/batch={found[-1]}").collect()  # one row a bucket
    return {r["bucket"]: r["batch"] for r in rows if r["batch"] is not None}, rows[0]["buckets"] if rows else None


def read_mirror(spark: SparkSession, directory: str, schema: str, before: int | None = None, only: set[int] | None = None) -> DataFrame:
    """The rows as of the last batch (below ``before``); of some buckets only, if named."""
    live, _ = live_files(spark, directory, before)
    root = directory.rstrip("/")
    paths = [f"{root}/data/batch={n}/bucket={b}" for b, n in sorted(live.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def commit(spark: SparkSession, directory: str, batch: int, changed: DataFrame, schema: str, buckets: int = BUCKETS) -> int:
    """Put ``changed`` (rows of the schema, a key once) in place of the rows with those keys; the number of buckets written.

    The number of buckets is the mirror's, once it has one. Only touched buckets are read and written.
    """
    root, store = directory.rstrip("/"), Store(spark, directory)
    live, fixed = live_files(spark, directory, batch)
    buckets = fixed or buckets
    store.remove(f"manifests/batch={batch}")  # of a run that wasn't known to have ended
    touched = {r["bucket"] for r in changed.select(_bucket(buckets)).distinct().collect()}  # ``buckets`` numbers at most
    held = read_mirror(spark, directory, schema, batch, touched)
    rows = held.join(changed.select(*KEY), KEY, "left_anti").select(*changed.columns).unionByName(changed)
    rows = rows.withColumn("bucket", _bucket(buckets))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/batch={batch}")
    written = set(store.numbers(f"data/batch={batch}", "bucket"))
    named = {b: n for b, n in live.items() if b not in touched} | {b: batch for b in written}
    manifest = spark.createDataFrame([(b, n, buckets) for b, n in sorted(named.items())] or [(0, None, buckets)], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifests/batch={batch}")
    return len(written)


def forget(spark: SparkSession, directory: str, keep: int) -> None:
    """Remove all but the last ``keep`` manifests, and the files that none of those names."""
    store = Store(spark, directory)
    found = store.committed()
    kept, named = found[-keep:], set()
    for n in kept:
        named |= {(b, k) for b, k in live_files(spark, directory, n + 1)[0].items()}
    for n in found[:-keep]:
        store.remove(f"manifests/batch={n}")
    for n in store.numbers("data", "batch"):
        if kept and n > kept[-1]:
            continue  # a batch that is being written
        own = store.numbers(f"data/batch={n}", "bucket")
        lost = [b for b in own if (b, n) not in named]
        for b in lost:
            store.remove(f"data/batch={n}/bucket={b}")
        if len(lost) == len(own):
            store.remove(f"data/batch={n}")
