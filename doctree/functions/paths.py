"""Slash-separated paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dirname(path: Column) -> Column:
    """The part before the last slash; . where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"(?s)/[^/]*\z", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def join_clean(directory: Column, rel: Column) -> Column:
    """Both parts joined, without empty and . segments, with .. taking its parent along; . if nothing is left."""
    parts = F.split(F.concat_ws("/", directory, rel), "/")

    def step(acc, x):
        up = (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        return F.when((x == "") | (x == "."), acc).when(up, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))

    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(out == "", ".").otherwise(out)


def rel_path(directory: Column, target: Column) -> Column:
    """The path from a directory to a target, both from the same root."""
    clean = lambda p: F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    a, b = clean(directory), clean(target)
    shared = F.array_position(F.concat(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.array(F.lit(False))), F.lit(False)).cast("int") - 1
    up = F.array_repeat(F.lit(".."), F.size(a) - shared)
    down = F.filter(F.transform(b, lambda x, i: F.when(i >= shared, x)), lambda x: x.isNotNull())
    out = F.array_join(F.concat(up, down), "/")
    return F.when(out == "", ".").otherwise(out)


def attachment_dir(path: Column, local_root: Column, attachments_dir: Column) -> Column:
    """The directory of a page's files: that of its path below the root, the same for x.md and x/index.md."""
    rel = F.when(path.startswith(local_root), F.substr(path, F.length(local_root) + 1)).otherwise(path)
    own = F.when(basename(rel) == "index.md", dirname(rel)).otherwise(F.regexp_replace(rel, r"\.md\z", ""))
    return F.when(own.isin(".", ""), attachments_dir).otherwise(join_clean(attachments_dir, own))


def attachment_src(path: Column, filename: Column, local_root: Column, attachments_dir: Column) -> Column:
    """Where a page's image points: the file in the page's attachment directory, seen from the page."""
    return rel_path(dirname(path), F.concat_ws("/", attachment_dir(path, local_root, attachments_dir), filename))


def canonical_attachment_path(path: Column, src: Column, attachments_dir: Column) -> Column:
    """The attachment that a source means, first seen from the document, then from the root; null outside
    the attachments directory."""
    root = F.concat(F.regexp_replace(attachments_dir, "/+$", ""), F.lit("/"))
    own, top = join_clean(dirname(path), src), join_clean(F.lit(""), src)
    usable = F.coalesce(src, F.lit("")) != ""
    return F.when(usable & own.startswith(root), own).when(usable & top.startswith(root), top)
