"""Queries of pushes and exports that need inputs of their own, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctree.functions import frontmatter as fm
from doctree.jobs.inputs import spark_input
from doctree.jobs.queries import GEO, HAND_NAMED, geo, hand_named, query, roots, tree_of
from doctree.operators import hierarchy as hi
from doctree.operators import links as li
from doctree.operators import sync as sy

#: Files that have moved: every second one under another name; some had no page, some pages are gone.
_MOVED = """
SELECT c_mktsegment AS scope_id, c_custkey AS k, CAST(c_custkey AS STRING) AS n, concat('docs/old/cust-', CAST(c_custkey AS STRING), '.md') AS old_path,
       concat('docs/new/', CASE WHEN c_custkey % 2 = 0 THEN 'cust-' ELSE 'client-' END, CAST(c_custkey AS STRING), '.md') AS path FROM {customer}
"""


@query(f"""
SELECT scope_id, 'R' AS action, path, CASE WHEN k % 11 <> 0 THEN n END AS page_id, CASE WHEN k % 11 <> 0 THEN 'update' END AS op,
       CASE WHEN k % 11 = 0 OR k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN 'CUST ' || n ELSE 'Client ' || n END AS title, CASE WHEN k % 11 = 0 THEN 'no page id' END AS error
FROM ({_MOVED.format(customer="customer")})
""")
def push_renames(spark, sf_dir):
    """A title stays where its slug is the new name, else it is made from the name."""
    rows = spark_input(spark, sf_dir, _MOVED)
    head = fm.apply_front_matter(fm.front_matter(F.col("n"), F.lit(1)), F.lit("text\n"))
    content = F.when(F.col("k") % 11 == 0, F.lit("no page\n")).otherwise(head)
    base = rows.select("scope_id", F.col("old_path").alias("path"), content.alias("content"))
    pages = rows.where("k % 5 <> 0").select("scope_id", F.col("n").alias("page_id"), F.concat(F.lit("CUST "), "n").alias("title"))
    diffs = rows.select("scope_id", F.lit("R").alias("action"), "path", "old_path")
    return sy.build_push_ops(diffs, base, rows.select("scope_id", "path", content.alias("content")), pages)


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CASE l_orderkey % 4 WHEN 0 THEN 'attachment_unchanged' WHEN 1 THEN 'attachment_unchanged' WHEN 2 THEN 'attachment_unchanged' ELSE 'error' END ELSE 'error' END AS outcome FROM lineitem
""")
def classify_unchanged(spark, sf_dir):
    """The store's own phrases for bytes that it has already, in any case, with status 400 only."""
    from doctree.sources.wiki import UNCHANGED_MARKS, classify_responses

    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    k = F.col("l_orderkey") % 4
    phrase = F.when(k == 0, F.upper(F.lit(UNCHANGED_MARKS[0]))).when(k == 1, F.lit(UNCHANGED_MARKS[1])).when(k == 2, F.initcap(F.lit(UNCHANGED_MARKS[2]))).otherwise(F.lit("bytes differ"))
    rows = item.withColumn("status", F.when(F.col("l_linenumber") % 2 == 0, 400).otherwise(500)).withColumn("body", F.concat(F.lit('{"message":"'), phrase, F.lit('"}')))
    return classify_responses(rows).select("l_orderkey", "l_linenumber", "outcome")


#: Two attachments of one name a customer, and one of pages that no tree has.
_ATTACHED = """
SELECT r_name AS scope_id, CAST(c_custkey + x.extra AS STRING) AS page_id, CAST(c_custkey * 10 + x.k AS STRING) AS id, concat('f', CAST(c_custkey % 3 AS STRING), '.png') AS filename, concat('/dl/', CAST(c_custkey AS STRING), '/', CAST(x.k AS STRING)) AS download_path
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey CROSS JOIN (SELECT 1 AS k, 0 AS extra UNION ALL SELECT 9, 0 UNION ALL SELECT 5, 90000000) x
"""
_GEO_ATTACHED = _ATTACHED.format(customer="customer", nation="nation", region="region")


@query(
    GEO
    + f""", a AS ({_GEO_ATTACHED})
SELECT scope_id, page_id, id, filename, download_path, 'docs/_attachments/' || regexp_replace(regexp_replace(path, '^docs/', ''), '(/index)?[.]md$', '') || '/' || filename AS file
FROM a JOIN paths USING (scope_id, page_id) WHERE id LIKE '%9'"""
)
def export_attachments(spark, sf_dir):
    """Where a full export puts each page's attachments; of two with one name the later one."""
    from doctree.operators.export import export_attachments as export

    pages = geo(spark, sf_dir)
    return export(pages, roots(pages), spark_input(spark, sf_dir, _ATTACHED), "docs", text_ids=False)


@query(GEO + f", a AS ({_GEO_ATTACHED}) SELECT scope_id, page_id, filename, 'docs/_files/' || regexp_replace(regexp_replace(path, '^docs/', ''), '(/index)?[.]md$', '') || '/' || filename AS file FROM a JOIN paths USING (scope_id, page_id)")
def attachment_download_plan(spark, sf_dir):
    return li.attachment_download_plan(spark_input(spark, sf_dir, _ATTACHED), hi.paths_of(tree_of(geo(spark, sf_dir)), "docs"), "docs/", "docs/_files").select("scope_id", "page_id", "filename", "file")


@query("SELECT c_mktsegment AS scope_id, 'docs/_files/a' || c_custkey AS from_dir, 'docs/_files/b/a' || c_custkey AS to_dir FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def attachment_moves_existing(spark, sf_dir):
    """Of the directories of renamed pages those that are there."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("n", F.col("c_custkey").cast("string")).withColumn("scope_id", F.col("c_mktsegment"))
    to = F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("docs/b/a"), "n", F.lit("/index.md"))).otherwise(F.concat(F.lit("docs/a"), "n", F.lit("/index.md")))
    renames = c.select("scope_id", F.concat(F.lit("docs/a"), "n", F.lit(".md")).alias("from_path"), to.alias("to_path"))
    there = c.where("c_custkey % 3 = 0").select("scope_id", F.concat(F.lit("docs/_files/a"), "n").alias("dir"))
    return sy.attachment_moves(renames, "docs/", "docs/_files", there)


@query(GEO + f", hand AS ({HAND_NAMED}), every AS (SELECT scope_id, path FROM paths UNION ALL SELECT scope_id, path FROM hand) SELECT scope_id, count(*) AS pages, count(DISTINCT path) AS paths FROM every GROUP BY ALL")
def path_map_size(spark, sf_dir):
    paths = hi.paths_of(tree_of(geo(spark, sf_dir)), "docs").unionByName(hand_named(spark, sf_dir))
    return hi.path_map_size(paths)
