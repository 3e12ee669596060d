"""Page trees. ``pages``: scope_id, page_id, title, parent_page_id, version, position (listing order).

The tree is made from narrow columns only; bodies are joined afterwards by those who need them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctree.functions.slugs import collision_suffix, page_id_order, slugify
from doctree.functions.tables import numbered, work_table

KEY = ["scope_id", "page_id"]


def build_tree(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """Pages reachable from the roots (scope_id, page_id), with depth, ancestors (root first, without the page) and
    positions (those of the chain), by pointer doubling. A page stops at the nearest root above it.

    Every page holds the chain of its ancestors up to a page that it points to. A round appends the chain of that page,
    which has doubled too, so a tree of depth d takes log2(d) rounds. Pages whose chain has reached a root leave the loop,
    those that point to no page or whose chain repeats itself (a cycle) are dropped. Each round is written out.
    A column ``slug`` of ``pages`` is carried along as slugs of the chain below the root.
    """
    has_slug = "slug" in pages.columns
    slug = F.col("slug") if has_slug else F.lit(None).cast("string")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    is_root = F.coalesce("is_root", F.lit(False))
    narrow = pages.select(*KEY, "title", "parent_page_id", "version", "position", slug.alias("slug")).join(roots.select(*KEY, F.lit(True).alias("is_root")).distinct(), KEY, "left")
    rows = narrow.select(
        *KEY, "title", "parent_page_id", "version", "position", "slug",
        F.when(~is_root, F.col("parent_page_id")).alias("to"), none("string").alias("ancestors"),
        F.when(is_root, none("bigint")).otherwise(F.array(F.col("position").cast("long"))).alias("positions"),
        F.when(is_root, none("string")).otherwise(F.array("slug")).alias("slugs"),
    ).where(F.col("to").isNotNull() | is_root)
    rows = work_table(rows, "pages")
    done, open_ = rows.where("to is null"), rows.where("to is not null")
    while not open_.isEmpty():
        above = done.unionByName(open_).select("scope_id", F.col("page_id").alias("to"), F.col("to").alias("next"), F.col("ancestors").alias("up"), F.col("positions").alias("at"), F.col("slugs").alias("over"))
        chain = F.concat("up", F.array("to"), "ancestors")
        joined = open_.join(above, ["scope_id", "to"]).select(
            *KEY, "title", "parent_page_id", "version", "position", "slug", F.col("next").alias("to"),
            chain.alias("ancestors"), F.concat("at", "positions").alias("positions"), F.concat("over", "slugs").alias("slugs"),
        )
        once = (F.size(F.array_distinct("ancestors")) == F.size("ancestors")) & ~F.array_contains("ancestors", F.col("page_id"))
        rows = work_table(joined.where(F.col("to").isNull() | once), "chains")
        done, open_ = done.unionByName(rows.where("to is null")), rows.where("to is not null")
    tree = done.drop("to").withColumn("depth", F.size("ancestors"))
    return tree if has_slug else tree.drop("slug", "slugs")


def walk_bfs(tree: DataFrame) -> DataFrame:
    """(scope_id, page_id, bfs_ord): level by level, then by the parent's order, then by position. Rows are numbered
    by ranges of a level and set off by the levels above, so no window holds a whole tree or level."""
    sizes = tree.groupBy("scope_id", "depth").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("scope_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("scope_id", "depth", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = numbered(tree.select(*KEY, "depth", "positions"), ["scope_id", "depth"], ["positions", "page_id"], "n")
    return rows.join(sizes, ["scope_id", "depth"]).select(*KEY, (F.col("before") + F.col("n")).alias("bfs_ord"))


def ancestors(tree: DataFrame) -> DataFrame:
    return tree.select(*KEY, "ancestors")


def has_children(tree: DataFrame) -> DataFrame:
    parents = tree.select("scope_id", F.col("parent_page_id").alias("page_id")).distinct().withColumn("has_children", F.lit(True))
    return tree.select(*KEY).join(parents, KEY, "left").select(*KEY, F.coalesce("has_children", F.lit(False)).alias("has_children"))


def children_of(tree: DataFrame) -> DataFrame:
    """(scope_id, page_id, children): ids of the direct children in listing order."""
    kids = tree.where("depth > 0").groupBy("scope_id", "parent_page_id").agg(F.sort_array(F.collect_list(F.struct("position", "page_id"))).alias("kids"))
    return kids.select("scope_id", F.col("parent_page_id").alias("page_id"), F.transform("kids", lambda k: k["page_id"]).alias("children"))


def lookup_pages(tree: DataFrame, ids: DataFrame) -> DataFrame:
    return tree.join(ids.select(*KEY).distinct(), KEY, "left_semi")


def tree_size(tree: DataFrame) -> DataFrame:
    return tree.groupBy("scope_id").agg(F.count(F.lit(1)).alias("pages"))


def orphan_pages(pages: DataFrame, tree: DataFrame) -> DataFrame:
    """Pages that the tree did not reach."""
    return pages.join(tree.select(*KEY), KEY, "left_anti")


def cascade_delete(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """The tree without the given pages and all below them."""
    chain = tree.select(*KEY, F.explode(F.concat("ancestors", F.array("page_id"))).alias("at"))
    dead = ids.select("scope_id", F.col("page_id").alias("at")).distinct()
    gone = chain.join(dead, ["scope_id", "at"], "left_semi").select(*KEY).distinct()
    return tree.join(gone, KEY, "left_anti")


def disambiguate_siblings(pages: DataFrame, text_ids: bool = True) -> DataFrame:
    """pages with ``slug``: of siblings with one slug the lowest id keeps it, the others get a suffix. The window is
    over true namesakes only, so a parent with millions of children is no hot key."""
    named = pages.withColumn("base", slugify(F.col("title"), F.col("page_id")))
    first = F.row_number().over(Window.partitionBy("scope_id", "parent_page_id", "base").orderBy(page_id_order(F.col("page_id"))))
    suffix = collision_suffix(F.col("page_id"), text_ids)
    return named.withColumn("slug", F.when(first == 1, F.col("base")).otherwise(F.concat_ws("-", "base", suffix))).drop("base")


def compute_paths(pages: DataFrame, roots: DataFrame, local_root: str, text_ids: bool = True) -> DataFrame:
    """(scope_id, page_id, path): root/index.md, dir/slug/index.md for a page with children, else dir/slug.md."""
    tree = build_tree(disambiguate_siblings(pages, text_ids), roots)
    return paths_of(tree, local_root)


def paths_of(tree: DataFrame, local_root: str) -> DataFrame:
    base = F.lit(local_root.rstrip("/"))
    own = F.concat_ws("/", base, F.array_join("slugs", "/"))
    path = F.when(F.col("depth") == 0, F.concat(base, F.lit("/index.md"))).when(F.col("has_children"), F.concat(own, F.lit("/index.md"))).otherwise(F.concat(own, F.lit(".md")))
    return tree.join(has_children(tree), KEY).select(*KEY, path.alias("path"))


def path_to_page(paths: DataFrame, tree: DataFrame) -> DataFrame:
    """(scope_id, path, page_id): where pages share a path, the one last set in depth-first order."""
    placed = paths.join(tree.select(*KEY, "positions"), KEY)
    return placed.groupBy("scope_id", "path").agg(F.max(F.struct("positions", "page_id")).alias("m")).select("scope_id", "path", F.col("m.page_id").alias("page_id"))


def path_map_size(paths: DataFrame) -> DataFrame:
    """(scope_id, pages, paths): entries of a scope's maps; fewer paths than pages where some share one."""
    return paths.groupBy("scope_id").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("path").alias("paths"))


def path_conflicts(paths: DataFrame) -> DataFrame:
    return paths.groupBy("scope_id", "path").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")


def audit_paths(paths: DataFrame, local_root: str) -> DataFrame:
    """(scope_id, path, problem): paths that two pages share, or with segments that no slug makes."""
    base = local_root.rstrip("/")
    unsafe = paths.where(~F.col("path").rlike(rf"^{base}(/[a-z0-9-]+)*(/[a-z0-9-]+|/index)\.md$")).select("scope_id", "path", F.lit("unsafe").alias("problem"))
    return path_conflicts(paths).select("scope_id", "path", F.lit("shared").alias("problem")).unionByName(unsafe)
