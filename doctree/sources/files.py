"""Markdown trees and attachments as tables."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.functions.tables import work_table


def _relative(directory: str):
    """The path below the directory, from the file's URI."""
    base = directory.rstrip("/").split("://")[-1]
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"(?s)\A.*?" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")


def _store(directory: str):
    """(file system, base path) by Arrow; None where Arrow doesn't know the scheme."""
    from pyarrow import fs

    try:
        store, base = fs.FileSystem.from_uri(directory)
    except (ValueError, OSError):
        return None
    return store, base.rstrip("/")


#: Bytes of a file that are read at once.
READ_BYTES = 1 << 22
LISTED = "path string, is_dir boolean, bytes long"


def list_tree(spark: SparkSession, directory: str) -> DataFrame:
    """(path, bytes) of all files outside hidden directories, also in directories beginning with an underscore.

    A walk level by level: the directories of a level are listed by tasks, and the driver only asks whether any are left.
    """

    def listed(batches):
        from pyarrow import fs

        store, base = _store(directory)
        for pdf in batches:
            rows = []
            for folder in pdf["path"]:
                for x in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                    if not x.base_name.startswith("."):
                        rows.append((f"{folder}/{x.base_name}".lstrip("/"), x.type == fs.FileType.Directory, x.size or 0))
            yield pd.DataFrame(rows, columns=["path", "is_dir", "bytes"])

    level, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        below = work_table(level.repartition(spark.sparkContext.defaultParallelism).mapInPandas(listed, LISTED), "listing")
        files = below.where("not is_dir").select("path", "bytes")
        found = files if found is None else found.unionByName(files)
        level = below.where("is_dir").select("path")
        if level.isEmpty():
            return found


def _contents(files: DataFrame, directory: str) -> DataFrame:
    def read(batches):
        store, base = _store(directory)
        for pdf in batches:
            for path in pdf["path"]:  # a file a batch, so that a batch is no larger than its file
                with store.open_input_stream(f"{base}/{path}") as f:
                    yield pd.DataFrame({"path": [path], "content": [f.read().decode("utf-8", "replace")]})

    return files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism).mapInPandas(read, "path string, content string")


def read_markdown_tree(spark: SparkSession, directory: str, extra_roots: list[str] | None = None, scope_id: str = "default") -> DataFrame:
    """(scope_id, path, content) of all *.md files outside hidden directories. Where Arrow doesn't know the file system, Spark reads:
    that leaves out names that start with an underscore, so name such directories in ``extra_roots`` (relative)."""
    if _store(directory) is not None:
        rows = _contents(list_tree(spark, directory).where(F.col("path").endswith(".md")), directory)
        return rows.select(F.lit(scope_id).alias("scope_id"), "path", "content")
    roots = [directory, *(f"{directory.rstrip('/')}/{r}" for r in extra_roots or [])]
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(roots, wholetext=True)
    rows = rows.select(F.lit(scope_id).alias("scope_id"), _relative(directory).alias("path"), F.col("value").alias("content"))
    return rows.where(~F.exists(F.split("path", "/"), lambda s: s.startswith(".")))


def write_markdown_tree(files: DataFrame, directory: str) -> None:
    """Write (path, content) as files below a directory that all executors share: a path, or a URI of a file system that
    Arrow knows. Files are written whole, so a task that runs again writes the same; see publish_markdown_tree for replacing a tree."""

    def write(rows):
        store, base = _store(directory)
        made = set()
        for r in rows:
            to = f"{base}/{r['path']}"
            folder = to.rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(to) as f:
                f.write(r["content"].encode())

    files.select("path", "content").foreachPartition(write)


def publish_markdown_tree(files: DataFrame, directory: str) -> int:
    """Make the tree below a shared directory hold exactly ``files`` (path, content; a path once), of what this function has ever
    written there; other files stay. The number of files.

    Tasks first write under names of their attempt, and a table of those names is committed: files of attempts that died are in
    none. Then the committed ones are moved into place, files of the last publication that are in this table no more are
    removed, and the list ``.published`` is renewed. A run that dies in between is mended by running again.
    """
    from pyarrow import fs

    spark, found = files.sparkSession, _store(directory)
    if found is None:
        raise ValueError(f"no file system for {directory}")
    store, base = found
    store.create_dir(base, recursive=True)
    staging = f".staging-{uuid.uuid4().hex}"

    def stage(batches):
        store, base = _store(directory)
        own = f"{base}/{staging}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(own, recursive=True)
        for pdf in batches:
            names = [f"{own}/{uuid.uuid4().hex}" for _ in pdf["path"]]
            for name, content in zip(names, pdf["content"], strict=True):
                with store.open_output_stream(name) as f:
                    f.write(content.encode())
            yield pd.DataFrame({"path": pdf["path"], "staged": names})

    committed = work_table(files.select("path", "content").mapInPandas(stage, "path string, staged string"), "staged")

    def move(rows):
        store, base = _store(directory)
        made = set()
        for r in rows:
            to = f"{base}/{r['path']}"
            folder = to.rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            if store.get_file_info(r["staged"]).type != fs.FileType.NotFound:  # else an attempt before has moved it
                store.move(r["staged"], to)

    committed.foreachPartition(move)
    listed = f"{directory.rstrip('/')}/.published"
    if store.get_file_info(f"{base}/.published/_SUCCESS").type != fs.FileType.NotFound:
        before = spark.read.schema("path string").parquet(listed)

        def remove(rows):
            store, base = _store(directory)
            for r in rows:
                if store.get_file_info(f"{base}/{r['path']}").type != fs.FileType.NotFound:
                    store.delete_file(f"{base}/{r['path']}")

        before.join(committed, "path", "left_anti").foreachPartition(remove)
    committed.select("path").write.mode("overwrite").parquet(listed)
    if store.get_file_info(f"{base}/{staging}").type != fs.FileType.NotFound:
        store.delete_dir(f"{base}/{staging}")
    return committed.count()


def read_attachments(spark: SparkSession, directory: str) -> DataFrame:
    """(file, sha, bytes) of all files below the directory, outside hidden directories, empty ones too; the contents are hashed where
    they are read. Where Arrow doesn't know the file system, Spark reads, also leaving out names that start with an underscore; its
    reader of files skips empty ones, so these are listed apart."""
    if _store(directory) is not None:

        def hashed(batches):
            store, base = _store(directory)
            for pdf in batches:
                rows = []
                for path in pdf["path"]:
                    digest, size = hashlib.sha256(), 0
                    with store.open_input_stream(f"{base}/{path}") as f:
                        while part := f.read(READ_BYTES):
                            digest.update(part)
                            size += len(part)
                    rows.append((path, digest.hexdigest(), size))
                yield pd.DataFrame(rows, columns=["file", "sha", "bytes"])

        found = list_tree(spark, directory).select("path").repartition(spark.sparkContext.defaultParallelism)
        return found.mapInPandas(hashed, "file string, sha string, bytes long")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    full = rows.select(_relative(directory).alias("file"), F.sha2("content", 256).alias("sha"), F.col("length").alias("bytes"))
    empty = spark.createDataFrame(_empty_files(spark, directory), "file string")
    return full.unionByName(empty.select("file", F.sha2(F.lit(""), 256).alias("sha"), F.lit(0).cast("long").alias("bytes")))


def _empty_files(spark: SparkSession, directory: str) -> list[tuple[str]]:
    """Paths of the empty files below the directory, by Hadoop's file systems, without names that Spark's readers leave out."""
    top = spark._jvm.org.apache.hadoop.fs.Path(directory)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, open_ = store.makeQualified(top).toUri().getPath().rstrip("/"), [], [top]
    while open_:
        for x in store.listStatus(open_.pop()):
            if x.getPath().getName()[:1] in (".", "_"):
                continue
            if x.isDirectory():
                open_.append(x.getPath())
            elif x.getLen() == 0:
                found.append((x.getPath().toUri().getPath()[len(base) + 1 :],))
    return found
