"""Snapshots of files, (scope_id, path, content): compare, find renames, apply, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctree.functions.frontmatter import extract_front_matter, has_front_matter
from doctree.functions.tables import work_table
from doctree.operators.lines import merge_lines

AT = ["scope_id", "path"]


def _marked(files: DataFrame, as_: str) -> DataFrame:
    return files.select(*AT, F.sha2("content", 256).alias(f"{as_}_sha"), F.octet_length("content").alias(f"{as_}_size"))


def diff_snapshots(base: DataFrame, head: DataFrame, suffix: str = ".md") -> DataFrame:
    """(scope_id, action A/M/D, path): one full outer join of hashes; contents do not move."""
    pick = F.col("path").endswith(suffix)
    both = _marked(base.where(pick), "b").join(_marked(head.where(pick), "h"), AT, "full_outer")
    action = F.when(F.col("b_sha").isNull(), "A").when(F.col("h_sha").isNull(), "D").when(F.col("b_sha") != F.col("h_sha"), "M")
    return both.select("scope_id", action.alias("action"), "path").where("action is not null")


def _line_counts(files: DataFrame, name: str) -> DataFrame:
    """(scope_id, <name>, <name>_size, h, bytes, <name>_n) of each file's distinct lines; sizes and bytes count line ends."""
    rows = files.select("scope_id", F.col("path").alias(name), (F.octet_length("content") + 1).alias(f"{name}_size"), F.explode(F.split("content", "\n")).alias("line"))
    return rows.groupBy("scope_id", name, f"{name}_size", F.xxhash64("line").alias("h"), (F.octet_length("line") + 1).alias("bytes")).agg(F.count(F.lit(1)).alias(f"{name}_n"))


def rename_scores(gone: DataFrame, came: DataFrame, least: float) -> DataFrame:
    """(scope_id, old_path, new_path, score) of all pairs of files (scope_id, path, content) that share at least ``least`` of
    the larger one's bytes in lines. Each file's lines are put in order of the pairs they would make, and it is looked up by
    the first ones only, until the rest weigh less than ``least`` of it: pairs that score enough share one of those."""
    line = ["scope_id", "h", "bytes"]
    old, new = work_table(_line_counts(gone, "old_path"), "lines"), work_table(_line_counts(came, "new_path"), "lines")
    held = lambda d, n: d.groupBy(*line).agg(F.count(F.lit(1)).alias(n))
    met = held(old, "old_files").join(held(new, "new_files"), line).select(*line, (F.col("old_files") * F.col("new_files")).alias("pairs"))

    def lead(d: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("scope_id", name).orderBy("pairs", "h", "bytes").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.col(f"{name}_n") * F.col("bytes")).over(order), F.lit(0))
        rows = d.join(met, line, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0))).withColumn("before", before)
        return rows.where((F.col("pairs") > 0) & (F.col(f"{name}_size") - F.col("before") >= F.col(f"{name}_size") * least - 1e-6)).select(*line, name, f"{name}_size")

    sizes = F.least("old_path_size", "new_path_size") >= F.greatest("old_path_size", "new_path_size") * least - 1e-6
    pairs = lead(old, "old_path").join(lead(new, "new_path"), line).where(sizes).select("scope_id", "old_path", "new_path").distinct()
    shared = pairs.join(old, ["scope_id", "old_path"]).join(new, ["scope_id", "new_path", "h", "bytes"])
    scored = shared.groupBy("scope_id", "old_path", "old_path_size", "new_path", "new_path_size").agg(F.sum(F.least("old_path_n", "new_path_n") * F.col("bytes")).alias("common"))
    return scored.withColumn("score", F.col("common") / F.greatest("old_path_size", "new_path_size")).where(F.col("score") >= least).select("scope_id", "old_path", "new_path", "score")


def _in_order(scored: DataFrame) -> DataFrame:
    """(scope_id, old_path, path): each scope's pairs are read once, best first, and taken where both sides are free."""

    def run(batches):
        scope, old, new = None, set(), set()
        for pdf in batches:
            keep = []
            for s, o, n in zip(pdf["scope_id"], pdf["old_path"], pdf["new_path"], strict=True):
                if s != scope:
                    scope, old, new = s, set(), set()
                keep.append(o not in old and n not in new)
                if keep[-1]:
                    old.add(o)
                    new.add(n)
            yield pdf.loc[keep, ["scope_id", "old_path", "new_path"]].rename(columns={"new_path": "path"})

    rows = scored.repartition("scope_id").sortWithinPartitions("scope_id", F.desc("score"), "old_path", "new_path")
    return rows.mapInPandas(run, "scope_id string, old_path string, path string")


def match_best(scored: DataFrame) -> DataFrame:
    """(scope_id, old_path, path): pairs taken one to one, best score first, equal scores by old and new path, until none is
    left. Pairs that are best for both sides are taken at once, round after round, while that halves what is left; chains
    and ties, which give few such pairs a round, are then taken in order."""
    scored = work_table(scored, "scores")
    found, left = scored.limit(0).select("scope_id", "old_path", F.col("new_path").alias("path")), scored.count()
    while left:
        best = lambda side, other: F.row_number().over(Window.partitionBy("scope_id", side).orderBy(F.desc("score"), other))
        mutual = scored.withColumn("a", best("old_path", "new_path")).withColumn("b", best("new_path", "old_path")).where("a = 1 and b = 1").select("scope_id", "old_path", F.col("new_path").alias("path"))
        mutual = work_table(mutual, "renames")
        found = found.unionByName(mutual)
        scored = scored.join(mutual.select("scope_id", "old_path"), ["scope_id", "old_path"], "left_anti").join(mutual.select("scope_id", F.col("path").alias("new_path")), ["scope_id", "new_path"], "left_anti")
        scored = work_table(scored, "scores")
        before, left = left, scored.count()
        if left > before / 2:
            return found.unionByName(work_table(_in_order(scored), "renames"))
    return found


def detect_renames(diffs: DataFrame, base: DataFrame, head: DataFrame, min_similarity: float = 0.5) -> DataFrame:
    """diffs with deletions and additions paired to R (path, old_path): equal contents first, by path order; then files
    that share at least ``min_similarity`` of their bytes in lines, best first, equal scores by old and new path, until no
    pair is left. Pairs arise from shared lines only."""
    gone = diffs.where("action = 'D'").select(*AT).join(base.select(*AT, "content"), AT)
    came = diffs.where("action = 'A'").select(*AT).join(head.select(*AT, "content"), AT)
    same = lambda d, name: d.select("scope_id", F.col("path").alias(name), F.sha2("content", 256).alias("sha")).withColumn("n", F.row_number().over(Window.partitionBy("scope_id", "sha").orderBy(name)))
    equal = same(gone, "old_path").join(same(came, "new_path"), ["scope_id", "sha", "n"]).select("scope_id", "old_path", F.col("new_path").alias("path"))
    rest_gone = gone.join(equal.select("scope_id", F.col("old_path").alias("path")), AT, "left_anti")
    rest_came = came.join(equal.select(*AT), AT, "left_anti")
    found = equal.unionByName(match_best(rename_scores(rest_gone, rest_came, min_similarity)))
    plain = diffs.select("scope_id", "action", "path", F.lit(None).cast("string").alias("old_path"))
    plain = plain.join(found.select(*AT).withColumn("action", F.lit("A")), ["scope_id", "path", "action"], "left_anti")
    plain = plain.join(found.select("scope_id", F.col("old_path").alias("path")).withColumn("action", F.lit("D")), ["scope_id", "path", "action"], "left_anti")
    return plain.select("scope_id", "action", "path", "old_path").unionByName(found.select("scope_id", F.lit("R").alias("action"), "path", "old_path"))


def status_report(diffs: DataFrame) -> DataFrame:
    """(scope_id, line): a verb and the path of each difference."""
    verb = F.when(F.col("action") == "A", "create").when(F.col("action") == "M", "update").when(F.col("action") == "D", "delete").otherwise("rename")
    return diffs.select("scope_id", F.concat_ws(" ", verb, F.when(F.col("old_path").isNotNull(), F.concat_ws(" -> ", "old_path", "path")).otherwise(F.col("path"))).alias("line"))


def apply_ops(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """ops (scope_id, action, path, old_path, content): A and M upsert, D removes, R moves and rewrites."""
    touched = ops.select(*AT).unionByName(ops.where("old_path is not null").select("scope_id", F.col("old_path").alias("path"))).distinct()
    written = ops.where("action <> 'D'").select(*AT, "content")
    return snapshot.join(touched, AT, "left_anti").select(*AT, "content").unionByName(written)


def apply_pull_plan(mirror: DataFrame, plan: DataFrame, rendered: DataFrame) -> DataFrame:
    """plan (scope_id, page_id, action, from_path, to_path) on a mirror; rendered (scope_id, page_id, content) for writes.
    Renamed files keep their content unless they are written too. Only pages that classify_missing found ``deleted`` go:
    files of delete candidates, orphaned and unknown pages stay.

    Pages whose ids agree in their last six digits can share a path, and each keeps its row (path_conflicts tells them): a row of the plan
    means the file of its page, or one without a page id, and a write replaces what is at its path but the file of another page that
    the plan leaves there or has moved there. Of several files of a page the last in walk order is meant, as in managed_by_id."""
    x = extract_front_matter(F.col("content"))
    files = mirror.select(*AT, "content", F.when(has_front_matter(F.col("content")), x).alias("x")).select(*AT, "content", F.when(~F.col("x.error"), F.nullif(F.col("x.fm.page_id"), F.lit(""))).alias("owner"))
    meant = lambda a, b: [a[c] == b[c] for c in AT] + [a["owner"].isNull() | (a["owner"] == b["page_id"])]
    at = lambda action: plan.where(F.col("action") == action).select("scope_id", F.col("from_path").alias("path"), "page_id", "to_path")
    gone, moves = at("deleted"), at("rename")
    kept = files.join(gone, meant(files, gone), "left_anti")
    moved = kept.join(moves, meant(kept, moves), "left").select(kept["scope_id"], F.coalesce("to_path", kept["path"]).alias("path"), "content", "owner", F.col("to_path").isNotNull().alias("came"))
    last = files.where("owner is not null").groupBy("scope_id", "owner").agg(F.max(F.struct(F.split("path", "/").alias("walk"), "path")).alias("m"))
    calm = last.join(plan.select("scope_id", F.col("page_id").alias("owner")).distinct(), ["scope_id", "owner"], "left_anti")
    moved = moved.join(calm.select("scope_id", "owner", F.col("m.path").alias("path"), F.lit(True).alias("calm")), [*AT, "owner"], "left").withColumn("stays", F.col("came") | F.coalesce("calm", F.lit(False)))
    writes = plan.where("action in ('create', 'update')").join(rendered, ["scope_id", "page_id"]).select("scope_id", F.col("to_path").alias("path"), "page_id", "content")
    over = writes.select(*AT, "page_id")
    left = moved.join(over, [moved[c] == over[c] for c in AT] + [~moved["stays"] | moved["owner"].isNull() | (moved["owner"] == over["page_id"])], "left_anti")
    return left.select(*AT, "content").unionByName(writes.select(*AT, "content"))


def merge_snapshots(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(scope_id, path, outcome, content): unchanged, ours, theirs, both (the same change), merged or conflict (content
    null; also where one side changed what the other removed). Hashes decide; only texts changed on both sides are read
    by the line merge (see merge_lines). Paths that end up removed are left out."""
    sha = lambda d, n: d.select(*AT, F.sha2("content", 256).alias(n))
    rows = sha(base, "b").join(sha(ours, "o"), AT, "full_outer").join(sha(theirs, "t"), AT, "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    outcome = F.when(b.eqNullSafe(o) & b.eqNullSafe(t), "unchanged").when(b.eqNullSafe(t), "ours").when(b.eqNullSafe(o), "theirs").when(o.eqNullSafe(t), "both").when(b.isNull() | o.isNull() | t.isNull(), "conflict").otherwise("merge")
    rows = rows.select(*AT, outcome.alias("outcome"))
    side = lambda d, *names: rows.where(F.col("outcome").isin(*names)).join(d.select(*AT, "content"), AT).select(*AT, "outcome", "content")
    plain = side(ours, "unchanged", "ours", "both").unionByName(side(theirs, "theirs"))
    clash = rows.where("outcome = 'conflict'").select(*AT, "outcome", F.lit(None).cast("string").alias("content"))
    name = lambda d, n: d.select(*AT, F.col("content").alias(n))
    open_ = rows.where("outcome = 'merge'").select(*AT).join(name(base, "b"), AT).join(name(ours, "o"), AT).join(name(theirs, "t"), AT)
    return plain.unionByName(clash).unionByName(merge_lines(open_))


def audit_converged(base: DataFrame, head: DataFrame) -> DataFrame:
    """(scope_id, converged, differing): a scope's snapshots agree when no path differs."""
    scopes = base.select("scope_id").union(head.select("scope_id")).distinct()
    n = diff_snapshots(base, head, "").groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"))
    return scopes.join(n, "scope_id", "left").select("scope_id", F.col("n").isNull().alias("converged"), F.coalesce("n", F.lit(0)).alias("differing"))
