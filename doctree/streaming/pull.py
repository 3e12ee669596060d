"""Incremental pull: page snapshots arrive as files, a mirror table follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.functions.frontmatter import apply_front_matter, front_matter
from doctree.functions.tables import work_table
from doctree.operators.convert import render_pages, storage_to_markdown
from doctree.operators.hierarchy import build_tree, disambiguate_siblings, paths_of, walk_bfs
from doctree.operators.sync import plan_pull
from doctree.streaming.mirror import BUCKETS, commit, forget, read_mirror

KEY = ["scope_id", "page_id"]
MIRROR = "scope_id string, page_id string, path string, version int, content string"


def latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each page: the highest version, then the latest arrival."""
    return snapshots.groupBy(*KEY).agg(F.max(F.struct("version", "seq", "path", "body")).alias("m")).select(*KEY, "m.version", "m.path", "m.body")


def upsert(mirror: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The mirror with pages whose version differs written again; a page with its version unchanged stays as it is, so
    a replay changes nothing. A batch never deletes: it doesn't show all pages."""
    new = latest(snapshots).withColumnsRenamed({"version": "n_version", "path": "n_path", "body": "n_body"})
    both = mirror.join(new, KEY, "full_outer")
    write = F.col("n_version").isNotNull() & ~F.col("version").eqNullSafe(F.col("n_version"))
    content = apply_front_matter(front_matter(F.col("page_id"), F.col("n_version")), F.col("n_body"))
    return both.select(*KEY, F.when(write, F.col("n_path")).otherwise(F.col("path")).alias("path"), F.when(write, F.col("n_version")).otherwise(F.col("version")).alias("version"), F.when(write, content).otherwise(F.col("content")).alias("content"))


#: A page as it arrives, and as the mirror holds it: ``body`` waits where a page can't be written yet.
PAGE = "scope_id string, page_id string, title string, parent_page_id string, version int, position long, body string, seq long"
HELD = "scope_id string, page_id string, title string, parent_page_id string, position long, version int, path string, content string, body string"


def changes(held: DataFrame, batch: DataFrame, local_root: str, base_url: str = "", text_ids: bool = True) -> DataFrame:
    """Rows of the mirror (HELD) that a batch of pages (PAGE) makes or changes.

    A page counts if its version is above the one held, and of several the highest, then the latest: what comes again or too
    late changes nothing. Paths are worked out for the trees that the batch touches, from narrow columns. Pages whose path
    changes are renamed, also those below a page that moved; new and updated ones are converted and written. A page without
    a way to its root waits with its body until its parents come; one whose body can't be read stays as it was.
    A batch shows some pages only, so nothing is deleted.
    """
    last = F.max(F.struct("version", "seq", "title", "parent_page_id", "position", "body")).alias("m")
    new = batch.groupBy(*KEY).agg(last).select(*KEY, "m.title", "m.parent_page_id", "m.position", "m.version", "m.body")
    known = held.select(*KEY, F.col("version").alias("old"))
    fresh = new.join(known, KEY, "left").where("old is null or version > old").drop("old")
    fresh = work_table(fresh, "fresh")
    scopes = fresh.select("scope_id").distinct()
    here = held.join(scopes, "scope_id", "left_semi")
    narrow = ["title", "parent_page_id", "position", "version"]
    pages = here.join(fresh.select(*KEY), KEY, "left_anti").select(*KEY, *narrow).unionByName(fresh.select(*KEY, *narrow))
    tree = work_table(build_tree(disambiguate_siblings(pages, text_ids), pages.where("parent_page_id is null")), "tree")
    paths = work_table(paths_of(tree, local_root), "paths")
    plan = plan_pull(tree, paths, here.where("path is not null")).where("action <> 'delete_candidate'").select(*KEY, "action")
    plan = work_table(plan.groupBy(*KEY).agg(F.bool_or(F.col("action") != "rename").alias("write")), "plan")
    waiting = here.where("body is not null").join(fresh.select(*KEY), KEY, "left_anti").select(*KEY, "version", "body")
    bodies = fresh.select(*KEY, "version", "body").unionByName(waiting)
    files = f"{local_root.rstrip('/')}/_attachments"
    written = bodies.join(plan.where("write"), KEY, "left_semi")
    rendered = render_pages(storage_to_markdown(written, tree, walk_bfs(tree), paths, base_url, local_root.rstrip("/") + "/", files)).select(*KEY, F.col("content").alias("new_content"))
    rows = pages.join(plan.select(*KEY).unionByName(fresh.select(*KEY)).distinct(), KEY, "left_semi")
    rows = rows.join(paths.withColumnRenamed("path", "new_path"), KEY, "left").join(rendered, KEY, "left").join(bodies.select(*KEY, F.col("body").alias("new_body")), KEY, "left")
    rows = rows.join(here.select(*KEY, F.col("path").alias("old_path"), F.col("content").alias("old_content"), F.col("version").alias("old_version")), KEY, "left")
    done = F.col("new_content").isNotNull()
    waits = ~done & F.col("new_body").isNotNull()
    return rows.select(
        *KEY, "title", "parent_page_id", "position", F.when(waits, F.col("old_version")).otherwise(F.col("version")).alias("version"),
        F.when(done | F.col("old_content").isNotNull(), F.coalesce("new_path", "old_path")).alias("path"), F.coalesce("new_content", "old_content").alias("content"), F.when(waits, F.col("new_body")).alias("body"),
    )


def incremental_pull(spark: SparkSession, stream: DataFrame, mirror_dir: str, checkpoint: str, local_root: str, base_url: str = "", text_ids: bool = True, buckets: int = BUCKETS, keep: int = 8):
    """Start the query: a stream of pages (PAGE) keeps a mirror (see mirror.py) that mirrored_files reads.

    A batch that runs again starts from the mirror before it and writes the same; the last ``keep`` states stay readable.
    """

    def step(batch: DataFrame, number: int) -> None:
        changed = work_table(changes(read_mirror(spark, mirror_dir, HELD, number), batch, local_root, base_url, text_ids), "changes")
        if not changed.isEmpty():
            commit(spark, mirror_dir, number, changed, HELD, buckets)
            forget(spark, mirror_dir, keep)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mirrored_files(spark: SparkSession, mirror_dir: str) -> DataFrame:
    """(scope_id, page_id, path, version, content) of the pages that are written."""
    return read_mirror(spark, mirror_dir, HELD).where("path is not null").select(*KEY, "path", "version", "content")
