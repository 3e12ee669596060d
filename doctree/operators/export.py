"""Full export of page trees: hierarchy, paths, conversion and managed files in one go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctree.functions.tables import work_table
from doctree.operators.convert import render_pages, storage_to_markdown
from doctree.operators.hierarchy import build_tree, disambiguate_siblings, paths_of, walk_bfs
from doctree.operators.links import attachment_download_plan


def export_scope(pages: DataFrame, roots: DataFrame, local_root: str, base_url: str = "", attachments_dir: str | None = None, text_ids: bool = True) -> DataFrame:
    """pages (scope_id, page_id, title, parent_page_id, version, position, body) -> (scope_id, page_id, path, content). Bodies are
    left out of the tree's joins and met once, at the conversion."""
    tree = work_table(build_tree(disambiguate_siblings(pages.drop("body"), text_ids), roots), "tree")
    paths = work_table(paths_of(tree, local_root), "paths")
    files = attachments_dir or f"{local_root.rstrip('/')}/_attachments"
    bodies = pages.select("scope_id", "page_id", "version", "body")
    return render_pages(storage_to_markdown(bodies, tree, walk_bfs(tree), paths, base_url, local_root.rstrip("/") + "/", files))


def export_attachments(pages: DataFrame, roots: DataFrame, attachments: DataFrame, local_root: str, attachments_dir: str | None = None, text_ids: bool = True) -> DataFrame:
    """attachments (scope_id, page_id, id, filename, download_path), as listed -> adds ``file``, where a full export puts each. Those of
    pages that no root reaches are left out; of one page's attachments with one name the largest id stays, as the file would be
    written last."""
    tree = work_table(build_tree(disambiguate_siblings(pages.drop("body"), text_ids), roots), "tree")
    files = attachments_dir or f"{local_root.rstrip('/')}/_attachments"
    key = ["scope_id", "page_id", "filename"]
    last = attachments.groupBy(*key).agg(F.max_by(F.struct("id", "download_path"), page_id_key(F.col("id"))).alias("m")).select(*key, "m.id", "m.download_path")
    plan = attachment_download_plan(last, paths_of(tree, local_root), local_root.rstrip("/") + "/", files)
    return last.join(plan, key).select("scope_id", "page_id", "id", "filename", "download_path", "file")


def page_id_key(c: Column) -> Column:
    """Numbers by size, before texts."""
    n = c.cast("string").try_cast("decimal(38,0)")
    return F.struct(n.isNull().alias("text"), n.alias("n"), c.alias("id"))
