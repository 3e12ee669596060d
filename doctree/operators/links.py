"""Links and attachments as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctree.functions.paths import attachment_dir, basename, canonical_attachment_path, dirname, join_clean, rel_path
from doctree.functions.text import url_query_escape


def resolve_page_links_by_id(links: DataFrame, paths: DataFrame) -> DataFrame:
    """links (scope_id, page_id, ordinal, content_id, title, space) that name a page of the tree: adds href, relative to
    the source page's directory."""
    source = paths.select("scope_id", "page_id", F.col("path").alias("from_path"))
    target = paths.select("scope_id", F.col("page_id").alias("content_id"), F.col("path").alias("to_path"))
    found = links.where(F.coalesce("content_id", F.lit("")) != "").join(target, ["scope_id", "content_id"]).join(source, ["scope_id", "page_id"])
    return found.select(*links.columns, rel_path(dirname(F.col("from_path")), F.col("to_path")).alias("href"))


def resolve_page_links_by_title(links: DataFrame, tree: DataFrame, order: DataFrame, paths: DataFrame) -> DataFrame:
    """Links without an id: to the first page in breadth-first order with that title; the space doesn't matter."""
    titles = tree.select("scope_id", "page_id", "title").join(order, ["scope_id", "page_id"])
    first = titles.groupBy("scope_id", "title").agg(F.min_by("page_id", "bfs_ord").alias("target"))
    wanted = links.where((F.coalesce("content_id", F.lit("")) == "") & (F.coalesce("title", F.lit("")) != ""))
    found = wanted.join(first, ["scope_id", "title"]).select(*[wanted[c] for c in links.columns if c != "content_id"], F.col("target").alias("content_id"))
    return resolve_page_links_by_id(found.select(*links.columns), paths)


def fallback_page_url(links: DataFrame, base_url: str) -> DataFrame:
    """A wiki URL for links that no page of the tree answers; null where there is nothing to name."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    path = (
        F.when(has("content_id") & has("space"), F.concat(F.lit("/spaces/"), "space", F.lit("/pages/"), "content_id"))
        .when(has("content_id"), F.concat(F.lit("/pages/viewpage.action?pageId="), "content_id"))
        .when(has("title"), F.concat(F.lit("/search?text="), url_query_escape(F.col("title"))))
    )
    return links.withColumn("href", F.concat(F.lit(base_url.rstrip("/")), path))


def unresolved_links(links: DataFrame, *resolved: DataFrame) -> DataFrame:
    """Links of which none of the resolutions has an answer."""
    key = ["scope_id", "page_id", "ordinal"]
    for r in resolved:
        links = links.join(r.select(*key), key, "left_anti")
    return links


def resolve_markdown_links(links: DataFrame, paths: DataFrame, tree: DataFrame) -> DataFrame:
    """links (scope_id, path, ordinal, target) to files of the tree: adds title and target page_id. External
    targets, mail addresses and bare fragments are left out; a fragment is dropped."""
    t = F.col("target")
    inner = links.where((F.coalesce(t, F.lit("")) != "") & ~t.contains("://") & ~t.startswith("#") & ~t.startswith("mailto:"))
    inner = inner.withColumn("to_path", join_clean(dirname(F.col("path")), F.substring_index("target", "#", 1)))
    titles = tree.select("scope_id", F.col("page_id").alias("target_page_id"), F.col("title").alias("target_title"))
    pages = paths.select("scope_id", F.col("path").alias("to_path"), F.col("page_id").alias("target_page_id")).join(titles, ["scope_id", "target_page_id"])
    return inner.join(pages, ["scope_id", "to_path"]).select(*links.columns, "target_page_id", "target_title")


def referenced_attachments(images: DataFrame, attachments_dir: str) -> DataFrame:
    """images (scope_id, path, ordinal, src) -> (scope_id, path, filename, file): the last reference of a name wins."""
    file = canonical_attachment_path(F.col("path"), F.col("src"), F.lit(attachments_dir))
    held = images.withColumn("file", file).where("file is not null").withColumn("filename", basename(F.col("file")))
    return held.groupBy("scope_id", "path", "filename").agg(F.max_by("file", "ordinal").alias("file"))


def attachment_upload_plan(refs: DataFrame, local_files: DataFrame, remote: DataFrame) -> DataFrame:
    """refs (scope_id, page_id, filename, file) against local (scope_id, file, sha) and remote (scope_id, page_id, filename,
    sha): missing, unchanged, new_version or new. Only hashes move."""
    local = local_files.select("scope_id", "file", F.col("sha").alias("local_sha"))
    there = remote.select("scope_id", "page_id", "filename", F.col("sha").alias("remote_sha"))
    found = refs.join(local, ["scope_id", "file"], "left").join(there, ["scope_id", "page_id", "filename"], "left")
    action = F.when(F.col("local_sha").isNull(), "missing").when(F.col("remote_sha").isNull(), "new").when(F.col("local_sha") == F.col("remote_sha"), "unchanged").otherwise("new_version")
    return found.select("scope_id", "page_id", "filename", "file", action.alias("action"))


def attachment_download_plan(attachments: DataFrame, paths: DataFrame, local_root: str, attachments_dir: str) -> DataFrame:
    """(scope_id, page_id, filename, file) for the attachments of pages that have a path."""
    found = attachments.join(paths, ["scope_id", "page_id"])
    file = F.concat_ws("/", attachment_dir(F.col("path"), F.lit(local_root), F.lit(attachments_dir)), "filename")
    return found.select("scope_id", "page_id", "filename", file.alias("file"))
