"""Page trees, files, links and snapshots made from the test tables, each by one SELECT that Spark and DuckDB share.

``{table}`` stands for a table; a WITH chain can name other inputs through sql_of().
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Part catalogue: root -> brand -> type -> part. Part names repeat, so siblings collide; some parents are missing.
CATALOG_PAGES = """
SELECT 'parts' AS scope_id, '1' AS page_id, 'Part Catalogue' AS title, CAST(NULL AS STRING) AS parent_page_id, 1 AS version, CAST(0 AS BIGINT) AS position
UNION ALL
SELECT 'parts', CAST(10 + b AS STRING), p_brand, '1', 1, CAST(b AS BIGINT)
FROM (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) AS b FROM (SELECT DISTINCT p_brand FROM {part}) x) y
UNION ALL
SELECT 'parts', CAST(1000 + n AS STRING), p_type, CAST(10 + b AS STRING), 1, CAST(n AS BIGINT)
FROM (SELECT p_brand, p_type, dense_rank() OVER (ORDER BY p_brand) AS b, dense_rank() OVER (ORDER BY p_brand, p_type) AS n FROM (SELECT DISTINCT p_brand, p_type FROM {part}) x) y
UNION ALL
SELECT 'parts', CAST(100000 + p.p_partkey AS STRING), p.p_name, CASE WHEN p.p_partkey % 97 = 0 THEN '999999' ELSE CAST(1000 + n AS STRING) END, CAST(1 + p.p_partkey % 7 AS INT), p.p_partkey
FROM {part} p JOIN (SELECT p_brand, p_type, dense_rank() OVER (ORDER BY p_brand, p_type) AS n FROM (SELECT DISTINCT p_brand, p_type FROM {part}) x) k ON p.p_brand = k.p_brand AND p.p_type = k.p_type
"""

#: Geography: region -> nation -> customers and suppliers, one tree a region.
GEO_PAGES = """
SELECT r_name AS scope_id, concat('r', CAST(r_regionkey AS STRING)) AS page_id, r_name AS title, CAST(NULL AS STRING) AS parent_page_id, 1 AS version, CAST(0 AS BIGINT) AS position FROM {region}
UNION ALL
SELECT r_name, concat('n', CAST(n_nationkey AS STRING)), n_name, concat('r', CAST(r_regionkey AS STRING)), 1, CAST(n_nationkey AS BIGINT) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT r_name, CAST(c_custkey AS STRING), c_name, concat('n', CAST(n_nationkey AS STRING)), CAST(1 + c_custkey % 3 AS INT), c_custkey FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT r_name, CAST(5000000 + s_suppkey AS STRING), s_name, concat('n', CAST(n_nationkey AS STRING)), 1, 5000000 + s_suppkey FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

#: Managed Markdown files of the documents, as base and head snapshots.
_FILE = """concat('---\nconfluence_page_id: "', CAST(doc_id AS STRING), '"\nconfluence_version: ', CAST(1 + doc_id % 7 AS STRING), '\nlang: ', lang, '\n---\n\n', text, '\n'"""
_PATH = """concat('docs/', lang, '/', source, '/page-', CAST(doc_id AS STRING), '.md')"""
BASE_FILES = f"SELECT lang AS scope_id, {_PATH} AS path, {_FILE}) AS content FROM {{documents}} WHERE doc_id % 10 <> 7"
HEAD_FILES = f"""SELECT lang AS scope_id, CASE WHEN doc_id % 11 = 0 THEN concat('docs/', lang, '/moved/page-', CAST(doc_id AS STRING), '.md') ELSE {_PATH} END AS path,
{_FILE}, CASE WHEN doc_id % 5 = 0 THEN 'One more line.\n' ELSE '' END) AS content FROM {{documents}} WHERE doc_id % 10 <> 3"""
THEIR_FILES = f"""SELECT lang AS scope_id, {_PATH} AS path, {_FILE}, CASE WHEN doc_id % 7 = 0 THEN 'Their line.\n' ELSE '' END) AS content FROM {{documents}} WHERE doc_id % 10 <> 7 AND doc_id % 13 <> 1"""

#: Wiki links between customers: by id, by title, and to pages that no tree has.
GEO_LINKS = """
SELECT r_name AS scope_id, CAST(c_custkey AS STRING) AS page_id, c_custkey AS ordinal,
       CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 9 = 0 THEN CAST(90000000 + c_custkey AS STRING) ELSE CAST((7 * c_custkey + 3) % 1500 AS STRING) END AS content_id,
       CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN concat('No Page ~ & ', CAST(c_custkey AS STRING)) WHEN c_custkey % 4 = 0 THEN n_name ELSE '' END AS title,
       CASE WHEN c_custkey % 2 = 0 THEN 'GEO' ELSE '' END AS space
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

TABLES = re.compile(r"\{(\w+)\}")


def spark_input(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(TABLES.findall(sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(sql: str) -> str:
    """The same SELECT for DuckDB, where the tables are views."""
    return TABLES.sub(r"\1", sql)

_X = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_N = "CAST(doc_id AS STRING)"
#: Wiki pages of the documents: a heading, a paragraph a line, links, an image, tasks, a table, code, a panel, a fence.
CORPUS_PAGES = f"""SELECT lang AS scope_id, {_N} AS page_id, concat('Page ', {_N}) AS title, concat('<h2>Page ', {_N}, ' &amp; co</h2><p>', replace({_X}, '\n', '</p><p>'), '</p>',
'<p><a href="https://x.example/', {_N}, '?a=1&amp;b=2" title="t">out <b>there</b></a> <ac:link><ri:page ri:content-id="', CAST((7 * doc_id + 3) % 1000 AS STRING), '" ri:space-key="S"/><ac:link-body>see <strong>it</strong></ac:link-body></ac:link></p>',
'<ac:image ac:width="', CAST(doc_id % 100 AS STRING), '"><ri:attachment ri:filename="f', {_N}, '.png"/></ac:image>',
'<ac:task-list><ac:task><ac:task-status>', CASE WHEN doc_id % 2 = 0 THEN 'complete' ELSE 'incomplete' END, '</ac:task-status><ac:task-body>do <em>', {_N}, '</em></ac:task-body></ac:task></ac:task-list>',
'<table><tbody><tr><th>k</th><th style="text-align: right;">v</th></tr><tr><td>', {_N}, '</td></tr></tbody></table><hr/>',
'<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">Python</ac:parameter><ac:plain-text-body><![CDATA[x < ', {_N}, ']]></ac:plain-text-body></ac:structured-macro>',
'<ac:structured-macro ac:name="', CASE WHEN doc_id % 3 = 0 THEN 'info' ELSE 'warning' END, '"><ac:parameter ac:name="title">T', {_N}, '</ac:parameter><ac:rich-text-body><p>mind ', {_N}, '</p></ac:rich-text-body></ac:structured-macro>') AS body FROM {{documents}}"""
