"""Queries over streams made from the test tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from doctree.functions.tables import shared_dir
from doctree.jobs import inputs as inp
from doctree.jobs.inputs import spark_input
from doctree.jobs.queries import query, tree_sql

#: Geography after all batches: some customers have moved up to their region, some have a new title.
_CUSTOMER = "try_cast(g.page_id AS BIGINT) < 5000000"
_MOVED, _NAMED = (f"coalesce({_CUSTOMER} AND try_cast(g.page_id AS BIGINT) % {x}, FALSE)" for x in ("10 = 0", "15 = 1"))
FINAL_PAGES = f"""
SELECT g.scope_id, g.page_id, CASE WHEN {_NAMED} THEN concat(g.title, ' new') ELSE g.title END AS title, CASE WHEN {_MOVED} THEN r.page_id ELSE g.parent_page_id END AS parent_page_id,
       CAST(CASE WHEN {_MOVED} THEN 10 WHEN {_NAMED} THEN 20 ELSE g.version END AS INT) AS version, g.position
FROM ({inp.GEO_PAGES}) g JOIN (SELECT scope_id, page_id FROM ({inp.GEO_PAGES}) x WHERE parent_page_id IS NULL) r ON g.scope_id = r.scope_id
"""


@query(
    tree_sql(FINAL_PAGES)
    + r"""SELECT scope_id, page_id, path, CAST(version AS INT) AS version,
  '---' || chr(10) || 'confluence_page_id: "' || page_id || '"' || chr(10) || 'confluence_version: ' || version || chr(10) || '---' || chr(10) || chr(10) || replace(title, '_', '\_') || ' v' || version || chr(10) AS content
FROM t JOIN paths USING (scope_id, page_id)"""
)
def incremental_pull(spark, sf_dir):
    """A mirror that follows a stream of four files: customers before their nations, the rest, what has changed since, and the
    first pages again."""
    from doctree.streaming.pull import PAGE, mirrored_files
    from doctree.streaming.pull import incremental_pull as start

    folder = f"{shared_dir(spark)}/pull-{uuid.uuid4().hex}"
    body = F.concat(F.lit("<p>"), "title", F.lit(" v"), F.col("version").cast("string"), F.lit("</p>"))
    page = lambda df, seq: df.select("scope_id", "page_id", "title", "parent_page_id", F.col("version").cast("int").alias("version"), "position", body.alias("body"), F.lit(seq).cast("long").alias("seq"))
    first, last = spark_input(spark, sf_dir, inp.GEO_PAGES), spark_input(spark, sf_dir, FINAL_PAGES)
    customer = F.coalesce(F.expr("try_cast(page_id AS BIGINT) < 5000000"), F.lit(False))
    for n, part in enumerate((first.where(customer), first.where(~customer), last.where("version >= 10"), first)):
        page(part, n).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start(spark, stream, f"{folder}/mirror", f"{folder}/checkpoint", "docs", text_ids=False, buckets=8).awaitTermination()
    return mirrored_files(spark, f"{folder}/mirror")
