"""Page exports, listings, scopes, difference lists, payloads and responses as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "id string, type string, title string, version struct<number:int>, space struct<key:string>, ancestors array<struct<id:string>>, body struct<storage:struct<value:string,representation:string>>"
CHILDREN = f"parent_page_id string, start long, results array<struct<{PAGE.replace(' string', ':string').replace('version struct', 'version:struct').replace('space struct', 'space:struct').replace('ancestors array', 'ancestors:array').replace('body struct', 'body:struct')}>>"
ATTACHMENTS = "page_id string, results array<struct<id:string,title:string,_links:struct<download:string>>>"
#: How machine-made sync commits begin, and how a store says that an attachment has not changed.
SYNC_PREFIX = "chore(sync): confluence"
UNCHANGED_MARKS = (
    "same file name as an existing attachment",
    "file with the same name already exists",
    "attachment data has not changed",
)
SCOPE = "confluence_root_page_id string, confluence_space_key string, local_root string, attachments_dir string"


def _page_columns(p: str, parent: Column) -> list[Column]:
    return [F.col(f"{p}id").alias("page_id"), F.col(f"{p}title").alias("title"), parent.alias("parent_page_id"), F.col(f"{p}space.key").alias("space_key"), F.col(f"{p}body.storage.value").alias("body"), F.col(f"{p}version.number").alias("version")]


def read_page_export(spark: SparkSession, path: str, scope_id: str = "default") -> DataFrame:
    """One row a page of a JSON export; the parent is the last ancestor."""
    pages = spark.read.schema(PAGE).json(path)
    parent = F.try_element_at(F.col("ancestors"), F.lit(-1))["id"]
    return pages.select(F.lit(scope_id).alias("scope_id"), *_page_columns("", parent))


def read_child_listings(spark: SparkSession, path: str, scope_id: str = "default") -> DataFrame:
    """One row a listed child; the parent is the listed one, positions follow the listing pages' order."""
    rows = spark.read.schema(CHILDREN).json(path).select("parent_page_id", F.coalesce("start", F.lit(0)).alias("start"), F.posexplode("results").alias("at", "r"))
    return rows.select(F.lit(scope_id).alias("scope_id"), *_page_columns("r.", F.col("parent_page_id")), (F.col("start") + F.col("at")).cast("long").alias("position"))


def read_attachment_listings(spark: SparkSession, path: str, filename: str | None = None) -> DataFrame:
    rows = spark.read.schema(ATTACHMENTS).json(path).select("page_id", F.explode("results").alias("r"))
    rows = rows.select("page_id", F.col("r.id").alias("id"), F.col("r.title").alias("filename"), F.col("r._links.download").alias("download_path"))
    return rows if filename is None else rows.where(F.col("filename") == filename)


def read_scopes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Scopes of configuration files, one each; without ``multi_line`` one a line, as write_scopes writes them."""
    return validate_scopes(spark.read.schema(SCOPE).option("multiLine", multi_line).json(path))


def validate_scopes(scopes: DataFrame) -> DataFrame:
    """Scopes with defaults (a closing slash, an attachments directory) and an error where root page or local root lack."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    error = F.when(blank("confluence_root_page_id"), "confluence_root_page_id is required").when(blank("local_root"), "local_root is required")
    root = F.when(F.col("local_root").endswith("/"), F.col("local_root")).otherwise(F.concat("local_root", F.lit("/")))
    files = F.when(blank("attachments_dir"), F.concat(root, F.lit("_attachments"))).otherwise(F.col("attachments_dir"))
    return scopes.select(
        F.col("confluence_root_page_id").alias("scope_id"), F.col("confluence_root_page_id").alias("root_page_id"), F.col("confluence_space_key").alias("space_key"),
        F.when(~blank("local_root"), root).alias("local_root"), F.when(~blank("local_root"), files).alias("attachments_dir"), error.alias("error"),
    )


def write_scopes(scopes: DataFrame, path: str) -> None:
    scopes.where("error is null").select(F.col("root_page_id").alias("confluence_root_page_id"), F.col("space_key").alias("confluence_space_key"), "local_root", "attachments_dir").write.json(path)


def parse_name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of a tab-separated name and status list -> (action, path, old_path); unknown and short lines are dropped."""
    part = F.split(F.col(column), "\t")
    status, n = F.get(part, F.lit(0)), F.size(part)
    rename = status.startswith("R") & (n >= 3)
    action = F.when(status.isin("A", "M", "D") & (n >= 2), status).when(rename, "R")
    return lines.select(action.alias("action"), F.when(rename, F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1))).alias("path"), F.when(rename, F.get(part, F.lit(1))).alias("old_path")).where("action is not null")


def is_sync_commit(message: Column) -> Column:
    return message.startswith(SYNC_PREFIX)


def _body(storage: Column) -> Column:
    return F.struct(F.struct(storage.alias("value"), F.lit("storage").alias("representation")).alias("storage"))


def _parents(parent: Column) -> Column:
    return F.when(F.coalesce(parent, F.lit("")) != "", F.array(F.struct(parent.alias("id"))))


def create_payloads(ops: DataFrame) -> DataFrame:
    """ops (scope_id, path, title, parent_page_id, space_key, storage) -> adds payload, the request body as JSON."""
    body = F.struct(F.lit("page").alias("type"), F.col("title"), _parents(F.col("parent_page_id")).alias("ancestors"), F.struct(F.col("space_key").alias("key")).alias("space"), _body(F.col("storage")).alias("body"))
    return ops.withColumn("payload", F.to_json(body))


def update_payloads(ops: DataFrame) -> DataFrame:
    """ops (…, version, title, parent_page_id, storage) -> adds payload; ancestors are left out without a parent."""
    body = F.struct(F.struct(F.col("version").alias("number")).alias("version"), F.col("title"), F.lit("page").alias("type"), _parents(F.col("parent_page_id")).alias("ancestors"), _body(F.col("storage")).alias("body"))
    return ops.withColumn("payload", F.to_json(body))


def classify_responses(responses: DataFrame, unchanged_marks=UNCHANGED_MARKS) -> DataFrame:
    """responses (status, body) -> adds outcome: ok, conflict, not_found, attachment_unchanged or error. ``unchanged_marks`` are
    the phrases (any case) by which the store refuses bytes it already has."""
    s = F.col("status")
    same = F.lit(False)
    for mark in unchanged_marks:
        same = same | F.lower("body").contains(mark.lower())
    outcome = F.when(s.between(200, 299), "ok").when(s == 409, "conflict").when(s == 404, "not_found").when((s == 400) & same, "attachment_unchanged").otherwise("error")
    return responses.withColumn("outcome", outcome)
