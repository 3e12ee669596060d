"""Queries over readers and writers: what the test tables hold is written into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.functions import frontmatter as fm
from doctree.functions import text as tx
from doctree.functions.tables import shared_dir
from doctree.jobs.inputs import spark_input
from doctree.jobs.queries import query
from doctree.operators import snapshots as sn
from doctree.operators import sync as sy
from doctree.sources import files, wiki


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, name: str) -> str:
    path = _folder(df.sparkSession, name)
    df.write.json(path)
    return path


def _page(number, title, version, parents, body):
    """A page as an export holds it."""
    return [
        number.cast("string").alias("id"), F.lit("page").alias("type"), title.alias("title"),
        F.struct(version.cast("int").alias("number")).alias("version"), F.struct(F.lit("GEO").alias("key")).alias("space"),
        parents.alias("ancestors"),
        F.struct(F.struct(body.alias("value"), F.lit("storage").alias("representation")).alias("storage")).alias("body"),
    ]


@query("""
SELECT 'geo' AS scope_id, CAST(c_custkey AS VARCHAR) AS page_id, c_name AS title, 'GEO' AS space_key,
       CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'n' || c_nationkey END AS parent_page_id,
       '<p>"' || c_mktsegment || '" &amp; é</p>' AS body, CAST(1 + c_custkey % 5 AS INT) AS version
FROM customer
""")
def read_page_export(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    chain = F.array(F.struct(F.lit("top").alias("id")), F.struct(nation.alias("id")))
    parents = F.when(F.col("c_custkey") % 10 != 0, chain)
    body = F.concat(F.lit('<p>"'), "c_mktsegment", F.lit('" &amp; é</p>'))
    pages = c.select(*_page(F.col("c_custkey"), F.col("c_name"), 1 + F.col("c_custkey") % 5, parents, body))
    return wiki.read_page_export(spark, _written(pages, "export"), "geo")


@query("""
SELECT 'geo' AS scope_id, CAST(c_custkey AS VARCHAR) AS page_id, c_name AS title, 'n' || c_nationkey AS parent_page_id,
       CAST(1 + c_custkey % 5 AS INT) AS version, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS position
FROM customer
""")
def read_child_listings(spark, sf_dir):
    """Listings of 50 children each."""
    rows = spark_input(spark, sf_dir, "SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM {customer}")
    none = F.lit(None).cast("array<struct<id:string>>")
    page = F.struct(*_page(F.col("c_custkey"), F.col("c_name"), 1 + F.col("c_custkey") % 5, none, F.lit(None).cast("string")))
    start = (F.floor(F.col("n") / 50) * 50).alias("start")
    parent = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_page_id")
    lists = rows.groupBy(parent, start).agg(F.sort_array(F.collect_list(F.struct("n", page.alias("page")))).alias("kids"))
    lists = lists.select("parent_page_id", "start", F.transform("kids", lambda k: k["page"]).alias("results"))
    found = wiki.read_child_listings(spark, _written(lists, "listings"), "geo")
    return found.select("scope_id", "page_id", "title", "parent_page_id", "version", "position")


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS page_id, CAST(o_orderkey AS VARCHAR) AS id, 'plan ' || o_orderkey % 3 || '.pdf' AS filename,
       '/download/attachments/' || o_custkey || '/' || o_orderkey AS download_path FROM orders WHERE o_orderkey % 3 = 1
""")
def read_attachment_listings(spark, sf_dir):
    """One name of all that the listings hold."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    link = F.concat(F.lit("/download/attachments/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"))
    name = F.concat(F.lit("plan "), (F.col("o_orderkey") % 3).cast("string"), F.lit(".pdf"))
    held = F.struct(F.col("o_orderkey").cast("string").alias("id"), name.alias("title"), F.struct(link.alias("download")).alias("_links"))
    lists = o.groupBy(F.col("o_custkey").cast("string").alias("page_id")).agg(F.collect_list(held).alias("results"))
    return wiki.read_attachment_listings(spark, _written(lists, "attachments"), "plan 1.pdf")


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS scope_id, CAST(s_suppkey AS VARCHAR) AS root_page_id, s_name AS space_key, 'docs/' || s_suppkey || '/' AS local_root,
       CASE WHEN s_suppkey % 3 = 0 THEN 'files/' || s_suppkey ELSE 'docs/' || s_suppkey || '/_attachments' END AS attachments_dir, CAST(NULL AS VARCHAR) AS error
FROM supplier WHERE s_suppkey % 5 > 0
""")
def scopes(spark, sf_dir):
    """Scopes, some without a local root, validated, written and read again."""
    n = F.col("s_suppkey").cast("string")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    given = s.select(
        n.alias("confluence_root_page_id"), F.col("s_name").alias("confluence_space_key"),
        F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("docs/"), n)).alias("local_root"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("files/"), n)).alias("attachments_dir"),
    )
    path = _folder(spark, "scopes")
    wiki.write_scopes(wiki.validate_scopes(given), path)
    return wiki.read_scopes(spark, path, multi_line=False)


_FILES = """
SELECT concat('docs/', lang, '/', CASE WHEN doc_id % 4 = 0 THEN '.kept/' WHEN doc_id % 4 = 1 THEN 'a b/' ELSE '' END, 'p', CAST(doc_id AS STRING),
              CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.md' END) AS path, coalesce(text, '') AS content FROM {documents}
"""


@query("SELECT 's' AS scope_id, path, sha256(content) AS sha FROM (" + _FILES.format(documents="documents") + ") WHERE path LIKE '%.md' AND path NOT LIKE '%/.kept/%'")
def read_markdown_tree(spark, sf_dir):
    """A tree of files, written and read again: Markdown outside hidden directories."""
    folder = _folder(spark, "tree")
    files.write_markdown_tree(spark_input(spark, sf_dir, _FILES), folder)
    return files.read_markdown_tree(spark, folder, scope_id="s").select("scope_id", "path", F.sha2("content", 256).alias("sha"))


@query("SELECT path AS file, sha256(content) AS sha, octet_length(encode(content)) AS bytes FROM (" + _FILES.format(documents="documents") + ") WHERE path NOT LIKE '%/.kept/%'")
def read_attachments(spark, sf_dir):
    """All kinds of files; those in hidden directories are no attachments."""
    folder = _folder(spark, "attached")
    files.write_markdown_tree(spark_input(spark, sf_dir, _FILES), folder)
    return files.read_attachments(spark, folder)


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS is_sync FROM orders")
def is_sync_commit(spark, sf_dir):
    k = F.col("o_orderkey")
    message = F.when(k % 3 == 0, F.concat(F.lit(f"{wiki.SYNC_PREFIX} pull "), k.cast("string"))).when(k % 3 == 1, F.lit(f"fix: {wiki.SYNC_PREFIX}")).otherwise("docs")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", wiki.is_sync_commit(message).alias("is_sync"))


@query("""
SELECT c_custkey, '{"type":"page","title":"' || c_name || '",' || CASE WHEN c_custkey % 2 = 0 THEN '"ancestors":[{"id":"n' || c_nationkey || '"}],' ELSE '' END ||
       '"space":{"key":"GEO"},"body":{"storage":{"value":"<p>' || c_mktsegment || '</p>","representation":"storage"}}}' AS payload FROM customer
""")
def create_payloads(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    parent = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).otherwise("")
    body = F.concat(F.lit("<p>"), "c_mktsegment", F.lit("</p>")).alias("storage")
    ops = c.select("c_custkey", F.col("c_name").alias("title"), parent.alias("parent_page_id"), F.lit("GEO").alias("space_key"), body)
    return wiki.create_payloads(ops).select("c_custkey", "payload")


@query("SELECT o_orderkey, o_orderkey % 2 = 1 AND o_custkey % 3 = 0 AND o_orderkey % 5 > 0 AS is_empty FROM orders")
def is_empty_front_matter(spark, sf_dir):
    k = F.col("o_orderkey")
    block = fm.front_matter(
        F.when(k % 2 == 0, k.cast("string")).when(k % 4 == 1, F.lit("")), F.when(F.col("o_custkey") % 3 != 0, F.lit(2)),
        F.when(k % 5 == 0, F.array(F.lit("x: y"))),
    )
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", fm.is_empty_front_matter(block).alias("is_empty"))


@query(r"""
SELECT doc_id, sha256(replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g'), '^[\p{Z}\t-\r\x{85}]+|[\p{Z}\t-\r\x{85}]+$', '', 'g'), '\ ', '\' || chr(10))) AS sha FROM documents
""")
def collapse_whitespace(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.sha2(tx.collapse_whitespace(F.coalesce("text", F.lit(""))), 256).alias("sha"))


@query(r"""
SELECT doc_id, sha256(array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10))) AS quoted,
       sha256(array_to_string(list_transform(string_split(t, chr(10)), lambda x, i: CASE WHEN i = 1 OR x = '' THEN x ELSE '    ' || x END), chr(10))) AS indented,
       CASE WHEN doc_id % 3 = 0 THEN 'f' || doc_id WHEN doc_id % 3 = 1 THEN 'a.b' ELSE '.x' END AS stem
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""")
def line_prefixes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    name = F.when(k == 0, F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".png"))).when(k == 1, "a.b.c").otherwise(".x")
    return d.select("doc_id", F.sha2(tx.prefix_blockquote(text), 256).alias("quoted"), F.sha2(tx.indent_after_first(text, "    "), 256).alias("indented"), tx.strip_ext(name).alias("stem"))


_SWAPS = """
SELECT c_mktsegment AS scope_id, concat('p', CAST(c_custkey AS STRING)) AS from_path,
       CASE WHEN c_mktsegment = 'BUILDING' THEN concat('q', CAST(c_custkey AS STRING)) ELSE concat('p', CAST(c_custkey + 10 AS STRING)) END AS to_path FROM {customer}
"""


@query(f"""
WITH r AS ({_SWAPS.format(customer="customer")}), hit AS (SELECT DISTINCT a.scope_id FROM r a JOIN r b ON a.scope_id = b.scope_id AND a.to_path = b.from_path),
n AS (SELECT *, '.rename-staging/' || (row_number() OVER (PARTITION BY scope_id ORDER BY from_path) - 1) || '.md' AS mid FROM r WHERE scope_id IN (SELECT scope_id FROM hit))
SELECT scope_id, 1 AS phase, from_path, mid AS to_path FROM n UNION ALL SELECT scope_id, 2, mid, to_path FROM n
UNION ALL SELECT scope_id, 1, from_path, to_path FROM r WHERE scope_id NOT IN (SELECT scope_id FROM hit)
""")
def stage_colliding_renames(spark, sf_dir):
    """Renames along chains, which go through the staging directory, and in one scope past each other."""
    return sy.stage_renames(spark_input(spark, sf_dir, _SWAPS))


_TEXTS = {
    "b": "concat('1 ', n, '\n2\n3\n4\n5 ', n, '\n')",
    "o": "concat('1 ', n, CASE WHEN k % 2 = 0 THEN ' ours' ELSE '' END, '\n2\n3\n4\n5 ', n, '\n')",
    "t": "concat('1 ', n, '\n2', CASE WHEN k % 5 = 0 THEN ' theirs' ELSE '' END, '\n3\n4\n5 ', n, CASE WHEN k % 3 = 0 THEN ' theirs' ELSE '' END, '\n')",
}


@query("""
SELECT c_mktsegment AS scope_id, 'p' || c_custkey || '.md' AS path, outcome,
       CASE WHEN outcome <> 'conflict' THEN sha256('1 ' || c_custkey || CASE WHEN o THEN ' ours' ELSE '' END || chr(10) || '2' || CASE WHEN t2 THEN ' theirs' ELSE '' END || chr(10) || '3' || chr(10) || '4' || chr(10) || '5 ' || c_custkey || CASE WHEN t5 THEN ' theirs' ELSE '' END || chr(10)) END AS sha
FROM (
  SELECT *, CASE WHEN NOT o AND NOT t2 AND NOT t5 THEN 'unchanged' WHEN NOT t2 AND NOT t5 THEN 'ours' WHEN NOT o THEN 'theirs' WHEN t2 THEN 'conflict' ELSE 'merged' END AS outcome
  FROM (SELECT *, c_custkey % 2 = 0 AS o, c_custkey % 5 = 0 AS t2, c_custkey % 3 = 0 AS t5 FROM customer)
)
""")
def merge_texts(spark, sf_dir):
    """Sides that change other lines are merged; changes of neighbouring lines are a conflict."""
    of = lambda x: spark_input(spark, sf_dir, f"SELECT scope_id, path, {x} AS content FROM (SELECT c_mktsegment AS scope_id, concat('p', CAST(c_custkey AS STRING), '.md') AS path, CAST(c_custkey AS STRING) AS n, c_custkey AS k FROM {{customer}})")
    merged = sn.merge_snapshots(*(of(_TEXTS[side]) for side in "bot"))
    return merged.select("scope_id", "path", "outcome", F.sha2("content", 256).alias("sha"))


@query("""
SELECT c_mktsegment AS scope_id, 'docs/_files/a' || c_custkey AS dir FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0
""")
def attachment_removals(spark, sf_dir):
    """Of deleted pages' attachment directories those that are there."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("n", F.col("c_custkey").cast("string")).withColumn("scope_id", F.col("c_mktsegment"))
    deletes = c.where("c_custkey % 3 = 0").select("scope_id", F.concat(F.lit("docs/a"), "n", F.lit(".md")).alias("path"))
    there = c.where("c_custkey % 2 = 0").select("scope_id", F.concat(F.lit("docs/_files/a"), "n").alias("dir"))
    return sy.attachment_removals(deletes, "docs/", "docs/_files", there)


@query("""
WITH f AS (SELECT o_orderpriority AS scope_id, 'docs/part-' || o_custkey % 9 || '/sub-x' || o_orderkey % 50 AS deep, 'docs/part-' || o_custkey % 9 AS top FROM orders),
d AS (SELECT DISTINCT scope_id, deep AS dir FROM f UNION SELECT DISTINCT scope_id, top FROM f), m AS (SELECT * FROM d WHERE dir NOT LIKE 'docs/part-_' OR right(dir, 1) NOT IN ('1', '2'))
SELECT scope_id, dir || '/index.md' AS path, 'create' AS op, CASE WHEN dir LIKE '%/sub-x%' THEN 'Sub X' || string_split(dir, '/sub-x')[2] ELSE 'Part ' || right(dir, 1) END AS title,
       CASE WHEN dir LIKE '%/sub-x%' AND dir NOT LIKE 'docs/part-1/%' AND dir NOT LIKE 'docs/part-2/%' THEN string_split(dir, '/sub-x')[1] || '/index.md' END AS parent_path,
       CASE WHEN dir LIKE 'docs/part-1/%' THEN 'held1' WHEN dir LIKE 'docs/part-2/%' THEN 'held2' WHEN dir NOT LIKE '%/sub-x%' THEN 'root' END AS parent_page_id,
       CASE WHEN dir LIKE '%/sub-x%' THEN 2 ELSE 1 END AS depth
FROM m
""")
def create_parents(spark, sf_dir):
    """Pages to make for directories without one: below others that are made, below pages that are there, below the root."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    top = F.concat(F.lit("docs/part-"), (F.col("o_custkey") % 9).cast("string"))
    file = F.concat(top, F.lit("/sub-x"), (F.col("o_orderkey") % 50).cast("string"), F.lit("/p.md"))
    scope = F.col("o_orderpriority").alias("scope_id")
    all_scopes = o.select(scope).distinct()
    held = all_scopes.select("scope_id", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("k"))
    held = held.select("scope_id", F.concat(F.lit("docs/part-"), "k", F.lit("/index.md")).alias("path"), F.concat(F.lit("held"), "k").alias("page_id"))
    paths = o.select(scope, file.alias("path")).unionByName(held.select("scope_id", "path"))
    missing = sy.missing_parents(paths, "docs")
    return sy.create_parents(missing, held, all_scopes.withColumn("page_id", F.lit("root")), "docs")


#: Files three directories deep. Index files of b1 have a page, those of a2 and b2 none; a3's and b3's come with this push.
_DEEP = """
SELECT o_orderpriority AS scope_id, concat('docs/a', CAST(o_custkey % 5 AS STRING), '/b', CAST(o_orderkey % 6 AS STRING), '/c', CAST(o_orderkey % 4 AS STRING), '/p.md') AS path FROM {orders}
"""
_DEEP_INDEX = """
SELECT DISTINCT scope_id, path, page_id, own FROM (
  SELECT o_orderpriority AS scope_id, concat('docs/a', CAST(o_custkey % 5 AS STRING), CASE WHEN k IN ('2', '3') AND o_custkey % 5 = CAST(k AS INT) THEN '' ELSE concat('/b', k) END, '/index.md') AS path,
         CASE WHEN k = '1' THEN concat('id-a', CAST(o_custkey % 5 AS STRING)) ELSE '' END AS page_id, k = '3' AS own
  FROM {orders} CROSS JOIN (SELECT '1' AS k UNION ALL SELECT '2' UNION ALL SELECT '3') x
) y
"""


@query(f"""
WITH f AS ({_DEEP.format(orders="orders")}), ix AS ({_DEEP_INDEX.format(orders="orders")}), want AS (SELECT DISTINCT scope_id, path FROM f UNION SELECT scope_id, path FROM ix WHERE own),
up AS (SELECT scope_id, path, string_split(CASE WHEN path LIKE '%/index.md' THEN left(path, length(path) - length('/index.md')) ELSE path END, '/') AS s FROM want),
dirs AS (SELECT DISTINCT scope_id, path, unnest(range(2, len(s))) AS n, s FROM up),
st AS (SELECT d.scope_id, d.path, n, array_to_string(s[1:n], '/') AS dir, i.page_id, i.own FROM dirs d LEFT JOIN ix i ON i.scope_id = d.scope_id AND i.path = array_to_string(s[1:n], '/') || '/index.md'),
stop AS (SELECT scope_id, path, max(n) AS n FROM st WHERE page_id <> '' OR own GROUP BY ALL),
made AS (SELECT DISTINCT scope_id, dir FROM st LEFT JOIN stop USING (scope_id, path) WHERE st.n > coalesce(stop.n, 0)),
every AS (SELECT scope_id, path, NULL AS op, NULL AS title, array_to_string(s[1:len(s) - 1], '/') AS dir FROM up
  UNION ALL SELECT scope_id, dir || '/index.md', 'create', upper(left(split_part(dir, '/', -1), 1)) || substring(split_part(dir, '/', -1), 2), array_to_string(string_split(dir, '/')[1:-2], '/') FROM made)
SELECT e.scope_id, e.path, e.op, e.title, CASE WHEN i.own OR m.dir IS NOT NULL THEN e.dir || '/index.md' END AS parent_path,
       CASE WHEN NOT coalesce(i.own, FALSE) AND m.dir IS NULL THEN coalesce(i.page_id, 'root') END AS parent_page_id, len(string_split(e.path, '/')) - 2 AS depth
FROM every e LEFT JOIN ix i ON i.scope_id = e.scope_id AND i.path = e.dir || '/index.md' LEFT JOIN made m ON m.scope_id = e.scope_id AND m.dir = e.dir
""")
def ensure_parents(spark, sf_dir):
    """Parents below pages that are there, that this push makes, that have to be made, and below the root, three levels deep."""
    files = spark_input(spark, sf_dir, _DEEP)
    index = spark_input(spark, sf_dir, _DEEP_INDEX)
    ops = index.where("own").select("scope_id", "path")
    held = index.select("scope_id", "path", "page_id")
    return sy.ensure_parents(files.unionByName(ops), held, ops, files.select("scope_id", F.lit("root").alias("page_id")).distinct(), "docs")


@query("""
SELECT 'default' AS scope_id, 'docs/_seg' || c_custkey % 7 || '/' || c_mktsegment || '/c' || c_custkey || '.md' AS path, 'now ' || c_name || chr(10) AS content FROM customer WHERE c_custkey % 3 <> 0
""")
def publish_markdown_tree(spark, sf_dir):
    """A tree published twice: files that left the table are gone, others have their new text. Some directories begin with an underscore."""
    from doctree.sources import files

    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    path = F.concat(F.lit("docs/_seg"), (F.col("c_custkey") % 7).cast("string"), F.lit("/"), "c_mktsegment", F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".md"))
    of = lambda word: c.select(path.alias("path"), F.concat(F.lit(word), "c_name", F.lit("\n")).alias("content"), "c_custkey")
    folder = _folder(spark, "published")
    files.publish_markdown_tree(of("then ").where("c_custkey % 2 = 0"), folder)
    files.publish_markdown_tree(of("now ").where("c_custkey % 3 <> 0"), folder)
    return files.read_markdown_tree(spark, folder)
