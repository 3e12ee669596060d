"""Planning between a page tree and its mirror of managed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctree.functions.frontmatter import extract_front_matter, has_front_matter
from doctree.functions.paths import attachment_dir, basename, dirname
from doctree.functions.slugs import reverse_slugify, title_slugs_match
from doctree.functions.tables import numbered, work_table

KEY = ["scope_id", "page_id"]
STAGING = ".rename-staging"


def scan_managed_files(files: DataFrame, local_root: str) -> DataFrame:
    """files (scope_id, path, content) -> (scope_id, path, page_id, version): Markdown under the root, outside hidden
    directories, with valid front matter and a page id."""
    root = local_root.rstrip("/") + "/"
    hidden = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda s: s.startswith(".") & (F.length(s) > 1))
    held = files.where(F.col("path").endswith(".md") & F.col("path").startswith(root) & has_front_matter(F.col("content")) & ~hidden)
    read = held.select("scope_id", "path", extract_front_matter(F.col("content")).alias("x")).where(~F.col("x.error") & (F.col("x.fm.page_id") != ""))
    return read.select("scope_id", "path", F.col("x.fm.page_id").alias("page_id"), F.col("x.fm.version").alias("version"))


def managed_by_id(managed: DataFrame) -> DataFrame:
    """One file a page id: the last in walk order, which compares path segments."""
    last = F.max(F.struct(F.split("path", "/").alias("walk"), "path", "version")).alias("m")
    return managed.groupBy(*KEY).agg(last).select(*KEY, F.col("m.path").alias("path"), F.col("m.version").alias("version"))


def plan_pull(tree: DataFrame, paths: DataFrame, managed: DataFrame) -> DataFrame:
    """(scope_id, page_id, action, from_path, to_path, version): create, update (the versions differ), rename (the paths
    differ; both may apply) and delete_candidate, by one full outer join on the page id."""
    remote = tree.select(*KEY, F.col("version").alias("r_version")).join(paths.select(*KEY, F.col("path").alias("r_path")), KEY)
    local = managed_by_id(managed).select(*KEY, F.col("path").alias("l_path"), F.col("version").alias("l_version"))
    both = remote.join(local, KEY, "full_outer")
    here, there = F.col("l_path").isNotNull(), F.col("r_path").isNotNull()
    op = lambda name, a, b, v: F.struct(F.lit(name).alias("action"), a.alias("from_path"), b.alias("to_path"), v.cast("int").alias("version"))
    none, l, r = F.lit(None).cast("string"), F.col("l_path"), F.col("r_path")
    actions = F.array_compact(F.array(
        F.when(there & ~here, op("create", none, r, F.col("r_version"))),
        F.when(here & there & (l != r), op("rename", l, r, F.col("r_version"))),
        F.when(here & there & ~F.col("l_version").eqNullSafe(F.col("r_version")), op("update", none, r, F.col("r_version"))),
        F.when(here & ~there, op("delete_candidate", l, none, F.col("l_version"))),
    ))
    return both.select(*KEY, F.inline(actions))


def classify_missing(plan: DataFrame, registry: DataFrame) -> DataFrame:
    """Delete candidates by what the registry (scope_id, page_id, status) says: found is orphaned, 404 or absent is
    deleted, any other status is unknown."""
    lost = plan.where("action = 'delete_candidate'").join(registry.select(*KEY, "status"), KEY, "left")
    action = F.when(F.col("status").between(200, 299), "orphaned").when(F.coalesce("status", F.lit(404)) == 404, "deleted").otherwise("unknown")
    return lost.select(*KEY, action.alias("action"), "from_path")


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("scope_id", "action").agg(F.count(F.lit(1)).alias("n"))


def plan_is_noop(plan: DataFrame) -> DataFrame:
    """(scope_id, noop): nothing but orphaned and unknown pages."""
    return plan.groupBy("scope_id").agg((F.count_if(~F.col("action").isin("orphaned", "unknown")) == 0).alias("noop"))


def rename_collisions(renames: DataFrame) -> DataFrame:
    """Renames whose target is the source of another rename."""
    sources = renames.select("scope_id", F.col("from_path").alias("to_path")).distinct()
    return renames.join(sources, ["scope_id", "to_path"], "left_semi")


def stage_renames(renames: DataFrame, local_root: str = "") -> DataFrame:
    """(scope_id, phase, from_path, to_path): in two phases through a staging directory below ``local_root`` for scopes with a
    collision, else directly. Staging names are numbered by the source path."""
    staged = rename_collisions(renames).select("scope_id").distinct()
    columns = ["scope_id", "from_path", "to_path"]
    number = numbered(renames.join(staged, "scope_id", "left_semi").select(*columns), ["scope_id"], ["from_path", "to_path"], "i")
    direct = renames.join(staged, "scope_id", "left_anti").select("scope_id", F.lit(1).alias("phase"), "from_path", "to_path")
    mid = F.concat(F.lit(f"{local_root.rstrip('/')}/{STAGING}/".lstrip("/")), (F.col("i") - 1).cast("string"), F.lit(".md"))
    move = lambda phase, a, b: F.struct(F.lit(phase).alias("phase"), a.alias("from_path"), b.alias("to_path"))
    a, b = F.col("from_path"), F.col("to_path")
    return number.select("scope_id", F.inline(F.array(move(1, a, mid), move(2, mid, b)))).unionByName(direct)


def attachment_moves(renames: DataFrame, local_root: str, attachments_dir: str, existing: DataFrame | None = None) -> DataFrame:
    """(scope_id, from_dir, to_dir) of renames that move a page's attachment directory; with ``existing`` (scope_id, dir), only of
    directories that are there."""
    of = lambda c: attachment_dir(F.col(c), F.lit(local_root), F.lit(attachments_dir))
    moves = renames.select("scope_id", of("from_path").alias("from_dir"), of("to_path").alias("to_dir")).where("from_dir <> to_dir").distinct()
    if existing is None:
        return moves
    return moves.join(existing.select("scope_id", F.col("dir").alias("from_dir")), ["scope_id", "from_dir"], "left_semi").select(*moves.columns)


def attachment_removals(deletes: DataFrame, local_root: str, attachments_dir: str, existing: DataFrame) -> DataFrame:
    """(scope_id, dir): attachment directories, among the existing ones (scope_id, dir), of pages whose files (scope_id, path)
    are deleted."""
    own = attachment_dir(F.col("path"), F.lit(local_root), F.lit(attachments_dir))
    return deletes.select("scope_id", own.alias("dir")).distinct().join(existing.select("scope_id", "dir"), ["scope_id", "dir"], "left_semi")


def ensure_parents(files: DataFrame, held: DataFrame, ops: DataFrame, root_pages: DataFrame, local_root: str) -> DataFrame:
    """Parents of ``files`` (scope_id, path), and the pages to make so that every file has one.

    A file's parent is the page of its directory (of an index page, of the directory above). A directory's page is one that is
    there, ``held`` (scope_id, path of the index file, page_id; an index file without a page id is no page), else the index page
    that this push creates, ``ops`` (scope_id, path), else one to make, and that one's parent is found alike. Above the local root
    is the scope's root page, ``root_pages`` (scope_id, page_id); so it is for files outside.

    (scope_id, path, op, title, parent_path, parent_page_id, depth): op is ``create`` for pages to make and null for the files.
    parent_path is set where the parent is yet to be made; parents come first by depth. Resolved for all directories at once: a
    directory has to be made if every one between it and a file below has no page. Rows without a path are left out.
    """
    root = local_root.rstrip("/")
    up = lambda p: F.when(p.contains("/"), dirname(p))
    files = files.where("path is not null").select("scope_id", "path").distinct()
    files = files.withColumn("dir", F.when(basename(F.col("path")) == "index.md", up(up(F.col("path")))).otherwise(up(F.col("path"))))
    parts = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    chain = F.filter(chain, lambda d: d.startswith(root) & (d != root))
    above = files.select("scope_id", "dir").distinct().where("dir is not null").select("scope_id", "dir", F.posexplode(chain).alias("n", "at"))
    index = F.concat("at", F.lit("/index.md"))
    there = held.where(F.coalesce("page_id", F.lit("")) != "").groupBy("scope_id", F.col("path").alias("index")).agg(F.min("page_id").alias("held_id"))
    made = ops.select("scope_id", F.col("path").alias("index")).distinct().withColumn("own", F.lit(True))
    known = above.select("scope_id", "at").distinct().withColumn("index", index).join(there, ["scope_id", "index"], "left").join(made, ["scope_id", "index"], "left")
    known = work_table(known.select("scope_id", "at", "held_id", (F.col("held_id").isNull() & F.coalesce("own", F.lit(False))).alias("own")), "directories")
    has_page = F.col("held_id").isNotNull() | F.col("own")
    below = Window.partitionBy("scope_id", "dir").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = above.join(known, ["scope_id", "at"]).withColumn("met", F.max(has_page).over(below)).where(~F.col("met"))
    create = open_.select("scope_id", "at").distinct()
    depth = F.size(F.split("path", "/")) - F.lit(root.count("/") + 2)
    new = create.select("scope_id", index.alias("path"), F.lit("create").alias("op"), reverse_slugify(F.concat(basename(F.col("at")), F.lit(".md"))).alias("title"), up(F.col("at")).alias("dir"))
    old = files.select("scope_id", "path", F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("title"), "dir")
    old = old.join(new.select("scope_id", "path"), ["scope_id", "path"], "left_anti")  # a file whose page is made comes once
    of = known.join(create.withColumn("to_make", F.lit(True)), ["scope_id", "at"], "left").withColumnRenamed("at", "dir")
    roots = root_pages.select("scope_id", F.col("page_id").alias("root_id"))
    rows = new.unionByName(old).join(of, ["scope_id", "dir"], "left").join(roots, "scope_id", "left")
    pending = F.coalesce("own", F.lit(False)) | F.coalesce("to_make", F.lit(False))
    parent_path = F.when(F.col("held_id").isNull() & pending, F.concat("dir", F.lit("/index.md")))
    parent = F.when(parent_path.isNull(), F.coalesce("held_id", "root_id"))
    return rows.select("scope_id", "path", "op", "title", parent_path.alias("parent_path"), parent.alias("parent_page_id"), depth.alias("depth"))


def create_parents(missing: DataFrame, pages: DataFrame, root_pages: DataFrame, local_root: str, ops: DataFrame | None = None) -> DataFrame:
    """missing (scope_id, dir, index_path), as of missing_parents -> the pages to make for those directories and for the ones above
    that have an index file but no page: ensure_parents' rows for them."""
    rows = missing.select("scope_id", F.concat("dir", F.lit("/page.md")).alias("path"))
    none = ops if ops is not None else pages.limit(0)
    return ensure_parents(rows, pages, none, root_pages, local_root).where("op = 'create'")


def order_pull(plan: DataFrame) -> DataFrame:
    """The plan with ``phase`` (renames, deletes, writes), sorted by scope, phase and path."""
    phase = F.when(F.col("action") == "rename", 0).when(F.col("action").isin("delete_candidate", "deleted"), 1).otherwise(2)
    return plan.withColumn("phase", phase).orderBy("scope_id", "phase", F.coalesce("to_path", "from_path"))


def push_priority(action: Column, path: Column) -> Column:
    """0 index pages added or changed, 1 other additions and changes, 2 renames, 3 deletions."""
    write = action.isin("A", "M")
    return F.when(write & path.endswith("/index.md"), 0).when(write, 1).when(action == "R", 2).otherwise(3)


def order_push(diffs: DataFrame) -> DataFrame:
    return diffs.withColumn("priority", push_priority(F.col("action"), F.col("path"))).orderBy("scope_id", "priority", "path")


def build_push_ops(diffs: DataFrame, base: DataFrame, head: DataFrame, pages: DataFrame) -> DataFrame:
    """(scope_id, action, path, page_id, op, title, error). diffs: scope_id, action, path, old_path.

    A: adopted as an update where its front matter names an existing page, else created with a title from the file
    name. M: the page id of the base snapshot. D: the same; a page already gone is done. R: the id of the base at the old path;
    the title stays if its slug is the new base name. Without an id: an error.
    """
    ids = lambda files, as_: files.select("scope_id", F.col("path").alias(f"{as_}_path"), extract_front_matter(F.col("content")).alias("x")).select("scope_id", f"{as_}_path", F.when(~F.col("x.error"), F.nullif(F.col("x.fm.page_id"), F.lit(""))).alias(f"{as_}_id"))
    b, h = ids(base, "b"), ids(head, "h")
    rows = diffs.withColumn("b_path", F.when(F.col("action") == "R", F.col("old_path")).otherwise(F.col("path"))).withColumn("h_path", F.col("path"))
    rows = rows.join(b, ["scope_id", "b_path"], "left").join(h, ["scope_id", "h_path"], "left")
    wanted = F.when(F.col("action") == "A", F.col("h_id")).otherwise(F.col("b_id"))
    known = pages.select("scope_id", F.col("page_id").alias("wanted"), F.col("title").alias("known_title"))
    rows = rows.withColumn("wanted", wanted).join(known, ["scope_id", "wanted"], "left")
    there = F.col("known_title").isNotNull()
    name = F.regexp_replace(basename(F.col("path")), r"\.md\z", "")
    derived = reverse_slugify(basename(F.col("path")))
    op = F.when((F.col("action") == "A") & there, "update").when(F.col("action") == "A", "create").when(F.col("action") == "D", F.when(there, "delete").otherwise("gone")).otherwise("update")
    title = F.when(op == "create", derived).when((F.col("action") == "R") & there & ~title_slugs_match(F.col("known_title"), name), derived).otherwise(F.col("known_title"))
    page_id = F.when(op != "create", F.col("wanted"))
    error = F.when(F.col("action").isin("M", "R", "D") & F.col("wanted").isNull(), "no page id")
    return rows.select("scope_id", "action", "path", page_id.alias("page_id"), F.when(error.isNull(), op).alias("op"), F.when(error.isNull(), title).alias("title"), error.alias("error"))


def missing_parents(paths: DataFrame, local_root: str) -> DataFrame:
    """paths (scope_id, path) of a snapshot -> (scope_id, dir, index_path): directories on the way to a file that have no
    index file. Whether an index file has a page is for ensure_parents."""
    root = local_root.rstrip("/")
    inside = paths.where(F.col("path").startswith(root + "/"))
    rel = F.split(F.substring("path", len(root) + 2, 1 << 30), "/")
    depth = F.size(rel) - 1
    dirs = inside.select("scope_id", F.explode(F.transform(F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(rel, 1, i), "/"))).alias("rel_dir")).distinct()
    dirs = dirs.select("scope_id", F.concat(F.lit(root + "/"), "rel_dir").alias("dir")).withColumn("index_path", F.concat("dir", F.lit("/index.md")))
    return dirs.join(paths.select("scope_id", F.col("path").alias("index_path")), ["scope_id", "index_path"], "left_anti").select("scope_id", "dir", "index_path")


def reparented(renames: DataFrame) -> DataFrame:
    """Renames that changed the directory."""
    return renames.where(dirname(F.col("from_path")) != dirname(F.col("to_path")))


def next_versions(ops: DataFrame, pages: DataFrame) -> DataFrame:
    """ops (scope_id, page_id, seen) -> adds version: one above the version seen, or above the store's where it moved on."""
    now = pages.select(*KEY, F.col("version").alias("latest"))
    return ops.join(now, KEY, "left").withColumn("version", F.greatest("seen", F.coalesce("latest", "seen")) + 1)


def retry_set(diffs: DataFrame, successes: DataFrame) -> DataFrame:
    """Diffs without a success come again."""
    return diffs.join(successes.select("scope_id", "path").distinct(), ["scope_id", "path"], "left_anti")


def parent_pages(managed: DataFrame, local_root: str) -> DataFrame:
    """managed (scope_id, path, page_id) -> (scope_id, page_id, parent_page_id): for each file the page of the nearest directory
    above it that has an index page; null for the root page and for files outside the root."""
    root = local_root.rstrip("/")
    own_dir = F.when(basename(F.col("path")) == "index.md", dirname(dirname(F.col("path")))).otherwise(dirname(F.col("path")))
    inside = managed.where(F.col("path").startswith(root + "/") & (F.col("path") != f"{root}/index.md")).withColumn("dir", own_dir)
    parts = F.split("dir", "/")
    above = inside.select(*KEY, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "at"))
    index = managed.where(F.col("path").endswith("/index.md")).select("scope_id", dirname(F.col("path")).alias("at"), F.col("page_id").alias("index_id"))
    found = above.join(index, ["scope_id", "at"]).groupBy(*KEY).agg(F.max_by("index_id", "depth").alias("parent_page_id"))
    return managed.select(*KEY).join(found, KEY, "left")
