"""One query an operator over the test tables, and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.functions import frontmatter as fm
from doctree.functions import paths as ps
from doctree.functions import slugs as sl
from doctree.functions import text as tx
from doctree.functions.tables import work_table
from doctree.jobs import inputs as inp
from doctree.jobs.inputs import duck, spark_input
from doctree.operators import hierarchy as hi
from doctree.operators import links as li
from doctree.operators import snapshots as sn
from doctree.operators import sync as sy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_input(spark, sf_dir, inp.CATALOG_PAGES)


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_input(spark, sf_dir, inp.GEO_PAGES)


def roots(pages: DataFrame) -> DataFrame:
    return pages.where("parent_page_id is null").select("scope_id", "page_id")


def tree_of(pages: DataFrame, text_ids: bool = False) -> DataFrame:
    return hi.build_tree(hi.disambiguate_siblings(pages, text_ids), roots(pages))


# --- the same in SQL -------------------------------------------------------------------------------

SLUG = r"""regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower(title), '[\t\n\x0B\f\r\x{85}\p{Z}]+', '-', 'g'), '_', '-'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"""


def tree_sql(pages: str, root: str = "docs") -> str:
    return f"""
WITH RECURSIVE p AS ({duck(pages)}),
s AS (SELECT *, CASE WHEN {SLUG} = '' THEN 'page-' || page_id ELSE {SLUG} END AS base FROM p),
u AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY scope_id, parent_page_id, base ORDER BY TRY_CAST(page_id AS UBIGINT) IS NULL, TRY_CAST(page_id AS UBIGINT), page_id) = 1 THEN base
      ELSE base || '-' || lpad(CAST(TRY_CAST(page_id AS UBIGINT) % 1000000 AS VARCHAR), 6, '0') END AS slug FROM s),
t AS (SELECT scope_id, page_id, title, parent_page_id, version, position, slug, 0 AS depth, [page_id][1:0] AS ancestors, [position][1:0] AS positions, [slug][1:0] AS slugs FROM u WHERE parent_page_id IS NULL
      UNION ALL SELECT u.scope_id, u.page_id, u.title, u.parent_page_id, u.version, u.position, u.slug, t.depth + 1, list_append(t.ancestors, u.parent_page_id), list_append(t.positions, u.position), list_append(t.slugs, u.slug)
      FROM u JOIN t ON u.scope_id = t.scope_id AND u.parent_page_id = t.page_id),
k AS (SELECT DISTINCT scope_id, parent_page_id AS page_id, TRUE AS has FROM t WHERE depth > 0),
paths AS (SELECT t.scope_id, t.page_id, CASE WHEN depth = 0 THEN '{root}/index.md' WHEN has THEN '{root}/' || array_to_string(slugs, '/') || '/index.md' ELSE '{root}/' || array_to_string(slugs, '/') || '.md' END AS path
          FROM t LEFT JOIN k ON t.scope_id = k.scope_id AND t.page_id = k.page_id),
bfs AS (SELECT scope_id, page_id, row_number() OVER (PARTITION BY scope_id ORDER BY depth, positions, page_id) AS bfs_ord FROM t)
"""


CAT, GEO = tree_sql(inp.CATALOG_PAGES), tree_sql(inp.GEO_PAGES)


# --- hierarchy and paths ----------------------------------------------------------------------------


@query(CAT + "SELECT scope_id, page_id, path FROM paths")
def catalog_paths(spark, sf_dir):
    pages = catalog(spark, sf_dir)
    return hi.compute_paths(pages, roots(pages), "docs", text_ids=False)


@query(GEO + "SELECT scope_id, page_id, path FROM paths")
def geo_paths(spark, sf_dir):
    pages = geo(spark, sf_dir)
    return hi.compute_paths(pages, roots(pages), "docs", text_ids=False)


@query(CAT + "SELECT scope_id, page_id, depth, array_to_string(ancestors, '/') AS chain FROM t")
def build_tree(spark, sf_dir):
    return tree_of(catalog(spark, sf_dir)).select("scope_id", "page_id", "depth", F.array_join("ancestors", "/").alias("chain"))


@query(GEO + "SELECT scope_id, page_id, bfs_ord FROM bfs")
def walk_bfs(spark, sf_dir):
    return hi.walk_bfs(tree_of(geo(spark, sf_dir)))


@query(CAT + "SELECT t.scope_id, t.page_id, coalesce(has, FALSE) AS has_children FROM t LEFT JOIN k USING (scope_id, page_id)")
def has_children(spark, sf_dir):
    return hi.has_children(tree_of(catalog(spark, sf_dir)))


@query(GEO + "SELECT scope_id, parent_page_id AS page_id, string_agg(page_id, ',' ORDER BY position, page_id) AS children FROM t WHERE depth > 0 GROUP BY ALL")
def children_of(spark, sf_dir):
    return hi.children_of(tree_of(geo(spark, sf_dir))).select("scope_id", "page_id", F.array_join("children", ",").alias("children"))


_SUPPLIER_IDS = """
SELECT r_name AS scope_id, CAST(s_suppkey AS STRING) AS page_id FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, CAST(5000000 + s_suppkey AS STRING) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""


@query(GEO + f"SELECT scope_id, page_id, title FROM t SEMI JOIN ({duck(_SUPPLIER_IDS)}) i USING (scope_id, page_id)")
def lookup_pages(spark, sf_dir):
    ids = spark_input(spark, sf_dir, _SUPPLIER_IDS)
    return hi.lookup_pages(tree_of(geo(spark, sf_dir)), ids).select("scope_id", "page_id", "title")


@query(GEO + "SELECT scope_id, count(*) AS pages FROM t GROUP BY scope_id")
def tree_size(spark, sf_dir):
    return hi.tree_size(tree_of(geo(spark, sf_dir)))


@query(CAT + "SELECT scope_id, page_id, parent_page_id FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page_id = p.page_id)")
def orphan_pages(spark, sf_dir):
    pages = catalog(spark, sf_dir)
    return hi.orphan_pages(pages, tree_of(pages)).select("scope_id", "page_id", "parent_page_id")


@query(CAT + "SELECT scope_id, page_id FROM t WHERE NOT EXISTS (SELECT 1 FROM unnest(list_append(ancestors, page_id)) AS x(a) WHERE length(a) = 4 AND CAST(a AS INT) % 5 = 0)")
def cascade_delete(spark, sf_dir):
    tree = tree_of(catalog(spark, sf_dir))
    return hi.cascade_delete(tree, tree.where("depth = 2 and cast(page_id as int) % 5 = 0")).select("scope_id", "page_id")


@query(CAT + "SELECT scope_id, path, arg_max(page_id, positions) AS page_id FROM paths JOIN t USING (scope_id, page_id) GROUP BY ALL")
def path_to_page(spark, sf_dir):
    tree = work_table(tree_of(catalog(spark, sf_dir)), "tree")
    return hi.path_to_page(hi.paths_of(tree, "docs"), tree)


#: Paths as people name them by hand: some are shared, some have capitals and blanks.
HAND_NAMED = """
SELECT lang AS scope_id, CAST(doc_id AS VARCHAR) AS page_id,
       'docs' || CASE WHEN doc_id % 11 = 0 THEN '/Draft ' ELSE '/draft-' END || doc_id // 3 || '.md' AS path
FROM documents
"""


def hand_named(spark, sf_dir):
    n = F.col("doc_id")
    name = F.when(n % 11 == 0, "/Draft ").otherwise("/draft-")
    path = F.concat(F.lit("docs"), name, F.floor(n / 3).cast("string"), F.lit(".md"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("lang").alias("scope_id"), n.cast("string").alias("page_id"), path.alias("path"))


@query(
    CAT
    + f""", hand AS ({HAND_NAMED}), every AS (SELECT scope_id, path FROM paths UNION ALL SELECT scope_id, path FROM hand)
SELECT scope_id, path, count(*) AS pages FROM every GROUP BY ALL HAVING count(*) > 1"""
)
def path_conflicts(spark, sf_dir):
    """A tree's paths have none; paths named by hand do."""
    paths = hi.paths_of(tree_of(catalog(spark, sf_dir)), "docs")
    return hi.path_conflicts(paths.unionByName(hand_named(spark, sf_dir)))


@query(f"WITH p AS ({duck(inp.CATALOG_PAGES)}) SELECT page_id, CASE WHEN {SLUG} = '' THEN 'page-' || page_id ELSE {SLUG} END AS slug FROM p")
def slugify(spark, sf_dir):
    return catalog(spark, sf_dir).select("page_id", sl.slugify(F.col("title"), F.col("page_id")).alias("slug"))


@query(f"WITH p AS (SELECT doc_id, coalesce(split_part(text, '.', 1), '') AS title, CAST(doc_id AS VARCHAR) AS page_id FROM documents) SELECT doc_id, CASE WHEN {SLUG} = '' THEN 'page-' || page_id ELSE {SLUG} END AS slug FROM p")
def document_slugs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    title = F.coalesce(F.substring_index("text", ".", 1), F.lit(""))
    return docs.select("doc_id", sl.slugify(title, F.col("doc_id").cast("string")).alias("slug"))


@query(CAT + """SELECT page_id, (SELECT string_agg(upper(x[1]) || x[2:], ' ' ORDER BY i) FROM (SELECT unnest(list_filter(string_split(replace(regexp_replace(slug, '^(.+)-[0-9]{6}$', '\\1'), '-', ' '), ' '), lambda w: w <> '')) AS x, generate_subscripts(list_filter(string_split(replace(regexp_replace(slug, '^(.+)-[0-9]{6}$', '\\1'), '-', ' '), ' '), lambda w: w <> ''), 1) AS i)) AS title FROM u""")
def reverse_slugify(spark, sf_dir):
    named = hi.disambiguate_siblings(catalog(spark, sf_dir), text_ids=False)
    return named.select("page_id", sl.reverse_slugify(F.concat("slug", F.lit(".md"))).alias("title"))


@query(f"WITH p AS (SELECT c_name AS title, c_custkey, c_mktsegment FROM customer) SELECT c_custkey, {SLUG} = replace(lower(title), '#', '') AS same FROM p")
def title_slugs_match(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", sl.title_slugs_match(F.col("c_name"), F.replace(F.lower("c_name"), F.lit("#"), F.lit(""))).alias("same"))


@query("SELECT o_orderkey, lpad(CAST(o_orderkey * 977 % 1000000 AS VARCHAR), 6, '0') AS suffix FROM orders")
def collision_suffix(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", sl.collision_suffix((F.col("o_orderkey") * 977).cast("string"), text_ids=False).alias("suffix"))


@query(CAT + "SELECT page_id, CASE WHEN path = 'docs/index.md' THEN 'docs/_files' WHEN path LIKE '%/index.md' THEN 'docs/_files/' || path[6:-10] ELSE 'docs/_files/' || path[6:-4] END AS dir FROM paths")
def attachment_dir(spark, sf_dir):
    at = hi.paths_of(tree_of(catalog(spark, sf_dir)), "docs")
    return at.select("page_id", ps.attachment_dir(F.col("path"), F.lit("docs/"), F.lit("docs/_files")).alias("dir"))


@query(GEO + """, x AS (SELECT page_id, path, CASE WHEN path LIKE '%/index.md' THEN path[6:-10] ELSE path[6:-4] END AS own, len(string_split(path, '/')) - 2 AS deep FROM paths WHERE path <> 'docs/index.md')
SELECT page_id, repeat('../', deep) || '_files/' || own || '/a.png' AS src, 'docs/_files/' || own || '/a.png' AS file FROM x""")
def attachment_links(spark, sf_dir):
    at = hi.paths_of(tree_of(geo(spark, sf_dir)), "docs").where("path <> 'docs/index.md'")
    src = ps.attachment_src(F.col("path"), F.lit("a.png"), F.lit("docs/"), F.lit("docs/_files"))
    return at.withColumn("src", src).select("page_id", "src", ps.canonical_attachment_path(F.col("path"), F.col("src"), F.lit("docs/_files")).alias("file"))


# --- front matter and text --------------------------------------------------------------------------


@query(f"SELECT path, page_id, version, extra, body FROM (SELECT concat('docs/', lang, '/', source, '/page-', doc_id, '.md') AS path, CAST(doc_id AS VARCHAR) AS page_id, CAST(1 + doc_id % 7 AS INT) AS version, 'lang: ' || lang AS extra, sha256(ltrim(replace(text, chr(13) || chr(10), chr(10)), chr(10)) || chr(10)) AS body FROM documents WHERE doc_id % 10 <> 7)")
def extract_front_matter(spark, sf_dir):
    x = spark_input(spark, sf_dir, inp.BASE_FILES).select("path", fm.extract_front_matter(F.col("content")).alias("x"))
    return x.select("path", F.col("x.fm.page_id").alias("page_id"), F.col("x.fm.version").alias("version"), F.array_join("x.fm.extra", "|").alias("extra"), F.sha2("x.body", 256).alias("body"))


@query(f"SELECT doc_id, sha256({duck(inp._FILE)})) AS file FROM documents")
def apply_front_matter(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = fm.front_matter(F.col("doc_id").cast("string"), 1 + F.col("doc_id") % 7, F.array(F.concat(F.lit("lang: "), "lang")))
    return d.select("doc_id", F.sha2(fm.apply_front_matter(head, F.concat("text", F.lit("\n"))), 256).alias("file"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x0B\f]+(\n|$)', '\1', 'g')) AS t FROM documents")
def pre_normalise(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(tx.pre_normalise(F.col("text")), 256).alias("t"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '([\\`*_\[\]<>])', '\\\1', 'g')) AS escaped, sha256(regexp_replace(text, '\\([\\`*_{}\[\]()#+.!|~>-])', '\1', 'g')) AS plain FROM documents")
def escape_inline_text(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.sha2(tx.escape_inline_text(F.col("text")), 256).alias("escaped"), F.sha2(tx.strip_backslash_escapes(F.col("text")), 256).alias("plain"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS attr, sha256('<![CDATA[' || replace(html, ']]>', ']]]]><![CDATA[>') || ']]>') AS cdata FROM pages")
def xml_escapes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.sha2(tx.xml_attr_escape(F.col("html")), 256).alias("attr"), F.sha2(tx.wrap_cdata(F.col("html")), 256).alias("cdata"))


@query("SELECT page_id, replace(url_encode(url || ' ~*' ), '%20', '+') AS escaped FROM pages")
def url_query_escape(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", tx.url_query_escape(F.concat("url", F.lit(" ~*"))).alias("escaped"))


@query("SELECT page_id, sha256(html) AS xml, '<gfl-fence data-v1-b64=\"' || to_base64(encode(html)) || '\"/>' AS inline_fence FROM pages")
def fences(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = tx.decode_block_fence(tx.encode_block_fence(F.col("html")))
    return p.select("page_id", F.sha2(back, 256).alias("xml"), tx.encode_inline_fence(F.col("html")).alias("inline_fence"))


@query("SELECT event_id, '<!--gfl:meta ' || 'a=\"' || replace(replace(props, '&', '&amp;'), '\"', '&quot;') || '\" kind=\"' || event_type || '\"-->' AS meta, props AS back FROM events")
def meta_comments(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    meta = tx.encode_meta(F.create_map(F.lit("kind"), "event_type", F.lit("a"), "props"))
    return e.withColumn("meta", meta).select("event_id", "meta", tx.decode_meta(F.col("meta"))["a"].alias("back"))


# --- links ------------------------------------------------------------------------------------------


def _geo_all(spark, sf_dir):
    tree = work_table(tree_of(geo(spark, sf_dir)), "tree")
    return tree, hi.paths_of(tree, "docs"), spark_input(spark, sf_dir, inp.GEO_LINKS)


REL = """CASE WHEN f.d = g.d THEN g.path[length(g.d) + 2:] ELSE '../' || g.path[6:] END"""
LINKS = GEO + f", l AS ({duck(inp.GEO_LINKS)}), w AS (SELECT scope_id, page_id, path, regexp_replace(path, '/[^/]*$', '') AS d FROM paths)"
BY_ID = f"SELECT l.scope_id, l.page_id, l.ordinal, {REL} AS href FROM l JOIN w f ON l.scope_id = f.scope_id AND l.page_id = f.page_id JOIN w g ON l.scope_id = g.scope_id AND l.content_id = g.page_id WHERE l.content_id <> ''"
BY_TITLE = f"SELECT l.scope_id, l.page_id, l.ordinal, {REL} AS href FROM l JOIN w f ON l.scope_id = f.scope_id AND l.page_id = f.page_id JOIN (SELECT t.scope_id, title, arg_min(page_id, bfs_ord) AS target FROM t JOIN bfs USING (scope_id, page_id) GROUP BY ALL) m ON l.scope_id = m.scope_id AND l.title = m.title JOIN w g ON l.scope_id = g.scope_id AND m.target = g.page_id WHERE l.content_id = '' AND l.title <> ''"


@query(LINKS + BY_ID)
def resolve_page_links_by_id(spark, sf_dir):
    _, paths, links = _geo_all(spark, sf_dir)
    return li.resolve_page_links_by_id(links, paths).select("scope_id", "page_id", "ordinal", "href")


@query(LINKS + BY_TITLE)
def resolve_page_links_by_title(spark, sf_dir):
    tree, paths, links = _geo_all(spark, sf_dir)
    return li.resolve_page_links_by_title(links, tree, hi.walk_bfs(tree), paths).select("scope_id", "page_id", "ordinal", "href")


@query(LINKS + f"""SELECT scope_id, page_id, ordinal, 'https://wiki' || CASE WHEN content_id <> '' AND space <> '' THEN '/spaces/' || space || '/pages/' || content_id WHEN content_id <> '' THEN '/pages/viewpage.action?pageId=' || content_id ELSE '/search?text=' || replace(url_encode(title), '%20', '+') END AS href
FROM l WHERE NOT EXISTS (SELECT 1 FROM ({BY_ID}) a WHERE a.scope_id = l.scope_id AND a.page_id = l.page_id) AND NOT EXISTS (SELECT 1 FROM ({BY_TITLE}) b WHERE b.scope_id = l.scope_id AND b.page_id = l.page_id)""")
def unresolved_links(spark, sf_dir):
    tree, paths, links = _geo_all(spark, sf_dir)
    rest = li.unresolved_links(links, li.resolve_page_links_by_id(links, paths), li.resolve_page_links_by_title(links, tree, hi.walk_bfs(tree), paths))
    return li.fallback_page_url(rest, "https://wiki/").select("scope_id", "page_id", "ordinal", "href")


@query(LINKS + f"SELECT a.scope_id, a.page_id, l.content_id AS target_page_id FROM ({BY_ID}) a JOIN l USING (scope_id, page_id)")
def audit_link_symmetry(spark, sf_dir):
    """Relative links resolve back to the page they were made for."""
    tree, paths, links = _geo_all(spark, sf_dir)
    made = li.resolve_page_links_by_id(links, paths).join(paths, ["scope_id", "page_id"])
    md = made.select("scope_id", "path", "ordinal", "page_id", F.concat("href", F.lit("#part")).alias("target"))
    return li.resolve_markdown_links(md, paths, tree).select("scope_id", "page_id", "target_page_id")


@query(LINKS + "SELECT scope_id, page_id, 'f' || page_id || '.png' AS filename, CASE WHEN TRY_CAST(page_id AS INT) % 5 = 0 THEN 'missing' WHEN TRY_CAST(page_id AS INT) % 3 = 0 THEN 'new' WHEN TRY_CAST(page_id AS INT) % 2 = 0 THEN 'unchanged' ELSE 'new_version' END AS action FROM l JOIN paths USING (scope_id, page_id)")
def attachment_upload_plan(spark, sf_dir):
    _, paths, links = _geo_all(spark, sf_dir)
    held = links.select("scope_id", "page_id", F.concat(F.lit("f"), "page_id", F.lit(".png")).alias("filename"))
    refs = li.attachment_download_plan(held, paths, "docs/", "docs/_files")
    n = F.col("page_id").try_cast("int")
    local = refs.where(n % 5 != 0).select("scope_id", "file", F.sha2("filename", 256).alias("sha"))
    remote = refs.where(n % 3 != 0).select("scope_id", "page_id", "filename", F.when(n % 2 == 0, F.sha2("filename", 256)).otherwise(F.lit("old")).alias("sha"))
    return li.attachment_upload_plan(refs, local, remote).drop("file")


# --- snapshots --------------------------------------------------------------------------------------


def base(spark, sf_dir):
    return spark_input(spark, sf_dir, inp.BASE_FILES)


def head(spark, sf_dir):
    return spark_input(spark, sf_dir, inp.HEAD_FILES)


SNAP = f"""WITH b AS ({duck(inp.BASE_FILES)}), h AS ({duck(inp.HEAD_FILES)}),
d AS (SELECT coalesce(b.scope_id, h.scope_id) AS scope_id, CASE WHEN b.path IS NULL THEN 'A' WHEN h.path IS NULL THEN 'D' ELSE 'M' END AS action, coalesce(b.path, h.path) AS path
      FROM b FULL JOIN h ON b.scope_id = h.scope_id AND b.path = h.path WHERE b.content IS DISTINCT FROM h.content)
"""


@query(SNAP + "SELECT * FROM d")
def diff_snapshots(spark, sf_dir):
    return sn.diff_snapshots(base(spark, sf_dir), head(spark, sf_dir))


@query()
def detect_renames(spark, sf_dir):
    b, h = base(spark, sf_dir), head(spark, sf_dir)
    return sn.detect_renames(work_table(sn.diff_snapshots(b, h), "diffs"), b, h)


@query(SNAP + "SELECT scope_id, CASE action WHEN 'A' THEN 'create ' WHEN 'M' THEN 'update ' ELSE 'delete ' END || path AS line FROM d")
def status_report(spark, sf_dir):
    d = sn.diff_snapshots(base(spark, sf_dir), head(spark, sf_dir))
    return sn.status_report(d.withColumn("old_path", F.lit(None).cast("string")))


@query(SNAP + "SELECT scope_id, action, path, CASE WHEN action IN ('A', 'M') THEN 1 ELSE 3 END AS priority FROM d")
def order_push(spark, sf_dir):
    return sy.order_push(sn.diff_snapshots(base(spark, sf_dir), head(spark, sf_dir)))


@query(SNAP + "SELECT scope_id, path, sha256(content) AS sha FROM h")
def apply_ops(spark, sf_dir):
    """The base with the differences applied is the head."""
    b, h = base(spark, sf_dir), head(spark, sf_dir)
    ops = sn.diff_snapshots(b, h).join(h, ["scope_id", "path"], "left").withColumn("old_path", F.lit(None).cast("string"))
    return sn.apply_ops(b, ops).select("scope_id", "path", F.sha2("content", 256).alias("sha"))


@query(SNAP + "SELECT s.scope_id, count(d.path) = 0 AS converged, count(d.path) AS differing FROM (SELECT DISTINCT scope_id FROM b UNION SELECT DISTINCT scope_id FROM h) s LEFT JOIN d USING (scope_id) GROUP BY s.scope_id")
def audit_converged(spark, sf_dir):
    return sn.audit_converged(base(spark, sf_dir), head(spark, sf_dir))


@query(SNAP + f""", t AS ({duck(inp.THEIR_FILES)}), o AS (SELECT * FROM h)
SELECT coalesce(b.scope_id, o.scope_id, t.scope_id) AS scope_id, coalesce(b.path, o.path, t.path) AS path,
CASE WHEN b.content IS NOT DISTINCT FROM o.content AND b.content IS NOT DISTINCT FROM t.content THEN 'unchanged' WHEN b.content IS NOT DISTINCT FROM t.content THEN 'ours' WHEN b.content IS NOT DISTINCT FROM o.content THEN 'theirs'
WHEN o.content IS NOT DISTINCT FROM t.content THEN 'both' ELSE 'conflict' END AS outcome
FROM b FULL JOIN o ON b.scope_id = o.scope_id AND b.path = o.path FULL JOIN t ON coalesce(b.scope_id, o.scope_id) = t.scope_id AND coalesce(b.path, o.path) = t.path
WHERE CASE WHEN b.content IS NOT DISTINCT FROM o.content AND b.content IS NOT DISTINCT FROM t.content THEN TRUE WHEN b.content IS NOT DISTINCT FROM t.content THEN o.path IS NOT NULL WHEN b.content IS NOT DISTINCT FROM o.content THEN t.path IS NOT NULL WHEN o.content IS NOT DISTINCT FROM t.content THEN o.path IS NOT NULL ELSE TRUE END""")
def merge_snapshots(spark, sf_dir):
    """Both sides append to a file, so a path changed by both is a conflict."""
    m = sn.merge_snapshots(base(spark, sf_dir), head(spark, sf_dir), spark_input(spark, sf_dir, inp.THEIR_FILES))
    return m.select("scope_id", "path", "outcome")


@query(SNAP + "SELECT scope_id, 'docs/' || dir AS dir, 'docs/' || dir || '/index.md' AS index_path FROM (SELECT DISTINCT scope_id, unnest([string_split(path, '/')[2], string_split(path, '/')[2] || '/' || string_split(path, '/')[3]]) AS dir FROM h)")
def missing_parents(spark, sf_dir):
    return sy.missing_parents(head(spark, sf_dir), "docs")


# --- planning ---------------------------------------------------------------------------------------


def mirror(spark, sf_dir):
    """Managed files of the part catalogue that lag behind: some missing, older, elsewhere or of unknown pages."""
    tree = work_table(tree_of(catalog(spark, sf_dir)), "tree")
    paths = hi.paths_of(tree, "docs")
    n = F.col("page_id").cast("long")
    rows = tree.select("scope_id", "page_id", "version").join(paths, ["scope_id", "page_id"]).where(n % 13 != 5)
    path = F.when(n % 17 == 3, F.concat(F.lit("docs/old/"), "page_id", F.lit(".md"))).otherwise(F.col("path"))
    rows = rows.select("scope_id", path.alias("path"), F.when(n % 19 == 2, F.concat(F.lit("9"), "page_id")).otherwise(F.col("page_id")).alias("page_id"), (F.col("version") + F.when(n % 5 == 1, 1).otherwise(0)).alias("version"))
    content = fm.apply_front_matter(fm.front_matter(F.col("page_id"), F.col("version")), F.lit("Body.\n"))
    return tree, paths, rows.select("scope_id", "path", content.alias("content"))


MIRROR = CAT + """, m AS (SELECT t.scope_id, CASE WHEN CAST(page_id AS BIGINT) % 17 = 3 THEN 'docs/old/' || page_id || '.md' ELSE path END AS path,
  CASE WHEN CAST(page_id AS BIGINT) % 19 = 2 THEN '9' || page_id ELSE page_id END AS page_id, CAST(t.version + CASE WHEN CAST(page_id AS BIGINT) % 5 = 1 THEN 1 ELSE 0 END AS INT) AS version
  FROM t JOIN paths USING (scope_id, page_id) WHERE CAST(page_id AS BIGINT) % 13 <> 5)
"""
PLAN = MIRROR + """, g AS (SELECT scope_id, page_id, arg_max(path, string_split(path, '/')) AS path, arg_max(version, string_split(path, '/')) AS version FROM m GROUP BY ALL),
r AS (SELECT t.scope_id, t.page_id, t.version, path FROM t JOIN paths USING (scope_id, page_id)),
x AS (SELECT coalesce(r.scope_id, g.scope_id) AS scope_id, coalesce(r.page_id, g.page_id) AS page_id, r.path AS rp, g.path AS lp, r.version AS rv, g.version AS lv FROM r FULL JOIN g ON r.scope_id = g.scope_id AND r.page_id = g.page_id),
plan AS (SELECT scope_id, page_id, 'create' AS action, NULL AS from_path, rp AS to_path, CAST(rv AS INT) AS version FROM x WHERE lp IS NULL
  UNION ALL SELECT scope_id, page_id, 'rename', lp, rp, rv FROM x WHERE lp <> rp
  UNION ALL SELECT scope_id, page_id, 'update', NULL, rp, rv FROM x WHERE lp IS NOT NULL AND rp IS NOT NULL AND lv <> rv
  UNION ALL SELECT scope_id, page_id, 'delete_candidate', lp, NULL, lv FROM x WHERE rp IS NULL)
"""


@query(MIRROR + "SELECT * FROM m")
def scan_managed_files(spark, sf_dir):
    return sy.scan_managed_files(mirror(spark, sf_dir)[2], "docs")


def _registry(files):
    """What a lookup of the mirror's pages says: found, not there (no row), or an error."""
    n = F.col("page_id").cast("long") % 3
    ids = files.select("scope_id", fm.extract_front_matter(F.col("content"))["fm"]["page_id"].alias("page_id")).distinct()
    return ids.where(n != 1).withColumn("status", F.when(n == 0, 200).otherwise(500))


def _plan(spark, sf_dir):
    tree, paths, files = mirror(spark, sf_dir)
    return sy.plan_pull(tree, paths, sy.scan_managed_files(files, "docs"))


@query(PLAN + "SELECT * FROM plan")
def plan_pull(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(PLAN + "SELECT scope_id, action, count(*) AS n FROM plan GROUP BY ALL")
def plan_counts(spark, sf_dir):
    return sy.plan_counts(_plan(spark, sf_dir))


@query(PLAN + "SELECT scope_id, page_id, CASE WHEN CAST(page_id AS BIGINT) % 3 = 0 THEN 'orphaned' WHEN CAST(page_id AS BIGINT) % 3 = 1 THEN 'deleted' ELSE 'unknown' END AS action, from_path FROM plan WHERE action = 'delete_candidate'")
def classify_missing(spark, sf_dir):
    tree, paths, files = mirror(spark, sf_dir)
    return sy.classify_missing(sy.plan_pull(tree, paths, sy.scan_managed_files(files, "docs")), _registry(files))


@query(PLAN + "SELECT scope_id, page_id, action, CASE action WHEN 'rename' THEN 0 WHEN 'delete_candidate' THEN 1 ELSE 2 END AS phase FROM plan")
def order_pull(spark, sf_dir):
    return sy.order_pull(_plan(spark, sf_dir)).select("scope_id", "page_id", "action", "phase")


@query(PLAN + ", sr AS (SELECT scope_id, from_path, to_path FROM plan WHERE action = 'rename') SELECT scope_id, 1 AS phase, from_path, to_path FROM sr WHERE NOT EXISTS (SELECT 1 FROM sr a JOIN sr b ON a.to_path = b.from_path)")
def stage_renames(spark, sf_dir):
    return sy.stage_renames(_plan(spark, sf_dir).where("action = 'rename'").select("scope_id", "from_path", "to_path"))


@query(PLAN + "SELECT scope_id, from_path, to_path FROM plan WHERE action = 'rename' AND regexp_replace(from_path, '/[^/]*$', '') <> regexp_replace(to_path, '/[^/]*$', '')")
def reparented(spark, sf_dir):
    return sy.reparented(_plan(spark, sf_dir).where("action = 'rename'").select("scope_id", "from_path", "to_path"))


@query(MIRROR + "SELECT m.scope_id, m.page_id, m.version AS seen, CAST(greatest(m.version, coalesce(t.version, m.version)) + 1 AS INT) AS version FROM m LEFT JOIN t ON m.scope_id = t.scope_id AND m.page_id = t.page_id")
def next_versions(spark, sf_dir):
    tree, _, files = mirror(spark, sf_dir)
    ops = sy.scan_managed_files(files, "docs").select("scope_id", "page_id", F.col("version").alias("seen"))
    return sy.next_versions(ops, tree).select("scope_id", "page_id", "seen", "version")


@query(SNAP + """, q AS (SELECT d.*, regexp_extract(path, 'page-([0-9]+)\\.md$', 1) AS id FROM d)
SELECT scope_id, action, path, CASE WHEN action = 'A' AND CAST(id AS BIGINT) % 3 = 0 THEN NULL ELSE id END AS page_id,
CASE WHEN action = 'A' THEN CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'create' ELSE 'update' END WHEN action = 'D' THEN CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'gone' ELSE 'delete' END ELSE 'update' END AS op,
CASE WHEN CAST(id AS BIGINT) % 3 <> 0 THEN 'Doc ' || id WHEN action = 'A' THEN 'Page ' || CASE WHEN length(id) = 6 THEN '' ELSE id END END AS title FROM q""")
def build_push_ops(spark, sf_dir):
    b, h = base(spark, sf_dir), head(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 <> 0").select(F.col("lang").alias("scope_id"), F.col("doc_id").cast("string").alias("page_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"))
    diffs = sn.diff_snapshots(b, h).withColumn("old_path", F.lit(None).cast("string"))
    return sy.build_push_ops(diffs, b, h, pages).select("scope_id", "action", "path", "page_id", "op", "title")


@query(SNAP + "SELECT scope_id, action, path FROM d WHERE action <> 'M'")
def retry_set(spark, sf_dir):
    d = work_table(sn.diff_snapshots(base(spark, sf_dir), head(spark, sf_dir)), "diffs")
    return sy.retry_set(d, d.where("action = 'M'")).select("scope_id", "action", "path")


# --- sources and streaming --------------------------------------------------------------------------


@query("""SELECT event_id, action, path, old_path FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'D' WHEN 2 THEN 'R' END AS action, CASE WHEN event_id % 4 = 2 THEN 'new/' || event_id || '.md' ELSE 'docs/' || event_id || '.md' END AS path, CASE WHEN event_id % 4 = 2 THEN 'docs/' || event_id || '.md' END AS old_path FROM events) WHERE action IS NOT NULL""")
def parse_name_status(spark, sf_dir):
    from doctree.sources.wiki import parse_name_status as parse

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    file = F.concat(F.lit("docs/"), F.col("event_id").cast("string"), F.lit(".md"))
    k = F.col("event_id") % 4
    line = F.when(k == 0, F.concat(F.lit("A\t"), file)).when(k == 1, F.concat(F.lit("D\t"), file)).when(k == 2, F.concat(F.lit("R100\t"), file, F.lit("\tnew/"), F.col("event_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("X\t"), file))
    rows = parse(e.select(line.alias("value")))
    return rows.withColumn("event_id", F.regexp_extract("path", r"/([0-9]+)\.md", 1).cast("long"))


@query("""SELECT page_id, '{"version":{"number":' || (page_id % 5 + 2) || '},"title":"T' || page_id || '","type":"page",' || CASE WHEN page_id % 2 = 0 THEN '"ancestors":[{"id":"1"}],' ELSE '' END || '"body":{"storage":{"value":"<p>' || page_id || '</p>","representation":"storage"}}}' AS payload FROM pages""")
def update_payloads(spark, sf_dir):
    from doctree.sources.wiki import update_payloads as payloads

    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n = F.col("page_id").cast("string")
    ops = p.select("page_id", (F.col("page_id") % 5 + 2).cast("int").alias("version"), F.concat(F.lit("T"), n).alias("title"), F.when(F.col("page_id") % 2 == 0, "1").otherwise("").alias("parent_page_id"), F.concat(F.lit("<p>"), n, F.lit("</p>")).alias("storage"))
    return payloads(ops).select("page_id", "payload")


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'conflict' WHEN 2 THEN 'not_found' WHEN 3 THEN 'attachment_unchanged' ELSE 'error' END AS outcome FROM lineitem")
def classify_responses(spark, sf_dir):
    from doctree.sources.wiki import classify_responses as classify

    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    k = F.col("l_linenumber") % 5
    status = F.when(k == 0, 204).when(k == 1, 409).when(k == 2, 404).otherwise(400)
    body = F.when(k == 3, "Same CONTENT as before").otherwise("bad request")
    return classify(item.withColumn("status", status).withColumn("body", body), ["same content"]).select("l_orderkey", "l_linenumber", "outcome")


@query("""SELECT 'u' || user_id % 10 AS scope_id, CAST(user_id AS VARCHAR) AS page_id, CAST(max(1 + event_id % 50) AS INT) AS version, '---\nconfluence_page_id: "' || user_id || '"\nconfluence_version: ' || max(1 + event_id % 50) || '\n---\n\n' || arg_max(event_type, (event_id % 50) * 100000000 + event_id) || '\n' AS content FROM events GROUP BY user_id""")
def upsert_mirror(spark, sf_dir):
    """Page versions from events, in two batches, the second one twice: the mirror holds each page's last version."""
    from doctree.streaming.pull import MIRROR, upsert

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    snaps = e.select(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("scope_id"), F.col("user_id").cast("string").alias("page_id"), F.concat(F.lit("docs/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), (1 + F.col("event_id") % 50).cast("int").alias("version"), F.concat("event_type", F.lit("\n")).alias("body"), F.col("event_id").alias("seq"))
    first = upsert(spark.createDataFrame([], MIRROR), snaps.where("version < 25"))
    return upsert(upsert(first, snaps), snaps).select("scope_id", "page_id", "version", "content")


# --- what bodies hold -------------------------------------------------------------------------------


def corpus(spark, sf_dir):
    return spark_input(spark, sf_dir, inp.CORPUS_PAGES)


@query("SELECT lang AS scope_id, CAST(doc_id AS VARCHAR) AS page_id, k.kind, CASE WHEN k.kind = 'external' THEN 'https://x.example/' || doc_id || '?a=1&b=2' END AS href, CASE WHEN k.kind = 'page' THEN CAST((7 * doc_id + 3) % 1000 AS VARCHAR) END AS content_id, CASE WHEN k.kind = 'page' THEN 'see it' ELSE 'out there' END AS text FROM documents, (VALUES ('external'), ('page')) k(kind)")
def extract_links(spark, sf_dir):
    from doctree.operators.extract import extract_links as extract

    return extract(corpus(spark, sf_dir)).select("scope_id", "page_id", "kind", "href", "content_id", "text")


@query("SELECT lang AS scope_id, CAST(doc_id AS VARCHAR) AS page_id, 'f' || doc_id || '.png' AS filename, 'f' || doc_id AS alt, CAST(doc_id % 100 AS VARCHAR) AS width FROM documents")
def extract_images(spark, sf_dir):
    from doctree.operators.extract import extract_images as extract

    return extract(corpus(spark, sf_dir)).select("scope_id", "page_id", "filename", "alt", F.col("attrs")["ac:width"].alias("width"))


@query("SELECT lang AS scope_id, CAST(doc_id AS VARCHAR) AS page_id, r AS row, c AS col, CAST(r AS INT) = 0 AS header, CASE WHEN r = 0 AND c = 1 THEN 'right' END AS align, CASE WHEN r = 0 AND c = 0 THEN 'k' WHEN r = 0 THEN 'v' WHEN c = 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS text FROM documents, range(2) a(r), range(2) b(c)")
def extract_tables(spark, sf_dir):
    from doctree.operators.extract import extract_tables as extract

    return extract(corpus(spark, sf_dir)).drop("ordinal")


@query("SELECT lang AS scope_id, CAST(doc_id AS VARCHAR) AS page_id, doc_id % 2 = 0 AS done, 'do ' || doc_id AS text FROM documents")
def extract_tasks(spark, sf_dir):
    from doctree.operators.extract import extract_tasks as extract

    return extract(corpus(spark, sf_dir)).drop("ordinal")


@query("SELECT lang AS scope_id, CAST(doc_id AS VARCHAR) AS page_id, CASE WHEN doc_id % 3 = 0 THEN 'INFO' ELSE 'ERROR' END AS label, 'T' || doc_id AS title, 'mind ' || doc_id AS text FROM documents")
def extract_panels(spark, sf_dir):
    from doctree.operators.extract import extract_panels as extract

    return extract(corpus(spark, sf_dir)).select("scope_id", "page_id", "label", "title", "text")


@query(f"""
WITH p AS ({duck(inp.CORPUS_PAGES)}), t AS (SELECT scope_id, unnest(regexp_extract_all(body, '<[A-Za-z][^<>]*>')) AS tag FROM p),
e AS (SELECT scope_id, lower(regexp_extract(tag, '^<([A-Za-z][A-Za-z0-9:-]*)', 1)) AS element, regexp_extract(tag, ' ac:name="([^"]*)"', 1) AS macro FROM t)
SELECT scope_id, CASE WHEN element = 'ac:structured-macro' THEN 'macro:' || macro ELSE element END AS construct,
       CASE WHEN element = 'ac:structured-macro' THEN CASE WHEN macro = 'code' THEN 'native' ELSE 'admonition' END
            WHEN element[:3] IN ('ri:') OR element IN ('ac:parameter', 'ac:rich-text-body', 'ac:plain-text-body', 'ac:link-body', 'ac:task-status', 'ac:task-body') THEN 'part' ELSE 'native' END AS handling,
       count(*) AS n
FROM e GROUP BY ALL
""")
def construct_census(spark, sf_dir):
    from doctree.operators.extract import construct_census as census

    return census(corpus(spark, sf_dir))


@query(r"""
WITH l AS (SELECT lang AS scope_id, doc_id, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT scope_id, doc_id, len(lines) AS n, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM l),
k AS (
  SELECT scope_id, doc_id, i + 1 AS ordinal, 'para' AS kind, trim(regexp_replace(line, '[ \t\r\n]+', ' ', 'g'), ' ') AS text FROM p
  UNION ALL SELECT scope_id, doc_id, 0, 'heading', 'Page ' || doc_id || ' & co' FROM l UNION ALL SELECT scope_id, doc_id, len(lines) + 1, 'para', 'out there see it' FROM l
  UNION ALL SELECT scope_id, doc_id, len(lines) + 2, 'image', '' FROM l UNION ALL SELECT scope_id, doc_id, len(lines) + 3, 'table', 'kv' || doc_id FROM l
  UNION ALL SELECT scope_id, doc_id, len(lines) + 4, 'hr', '' FROM l UNION ALL SELECT scope_id, doc_id, len(lines) + 5, 'code', 'x < ' || doc_id FROM l
  UNION ALL SELECT scope_id, doc_id, len(lines) + 6, 'para', 'mind ' || doc_id FROM l
)
SELECT scope_id, CAST(doc_id AS VARCHAR) AS page_id, CAST(ordinal AS INT) AS ordinal, kind, CASE WHEN kind = 'heading' THEN 2 ELSE 0 END AS level, CASE WHEN kind = 'code' THEN 'python' END AS lang, sha256(text) AS text FROM k
""")
def extract_blocks(spark, sf_dir):
    """All blocks, a panel's paragraph too; texts as digests."""
    from doctree.operators.extract import extract_blocks as extract

    return extract(corpus(spark, sf_dir)).withColumn("text", F.sha2("text", 256)).withColumn("level", F.coalesce("level", F.lit(0)))


@query("SELECT lang AS scope_id, concat('p', doc_id) AS path, k.kind, sha256(text) AS xml FROM documents, (VALUES ('block'), ('inline')) k(kind)")
def extract_fences(spark, sf_dir):
    from doctree.operators.extract import extract_fences as extract

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = F.concat(F.lit("Before\n\n"), tx.encode_block_fence(F.col("text")), F.lit("\n\nin "), tx.encode_inline_fence(F.col("text")), F.lit(" line\n"))
    files = d.select(F.col("lang").alias("scope_id"), F.concat(F.lit("p"), "doc_id").alias("path"), content.alias("content"))
    return extract(files).select("scope_id", "path", "kind", F.sha2("xml", 256).alias("xml"))


# --- conversion -------------------------------------------------------------------------------------


def _converted(spark, sf_dir):
    from doctree.operators.convert import storage_to_markdown as convert

    broken = F.when(F.col("page_id").cast("int") % 50 == 7, F.concat("body", F.lit("<p class"))).otherwise(F.col("body"))
    pages = corpus(spark, sf_dir).withColumn("version", (F.col("page_id").cast("int") % 7 + 1).cast("int")).withColumn("body", broken)
    paths = pages.select("scope_id", "page_id", F.concat(F.lit("docs/"), "scope_id", F.lit("/page-"), "page_id", F.lit(".md")).alias("path"))
    order = pages.select("scope_id", "page_id", F.col("page_id").cast("long").alias("bfs_ord"))
    return convert(pages, pages.select("scope_id", "page_id", "title"), order, paths, "https://wiki")


MD = r"""d AS (SELECT *, CAST(doc_id AS VARCHAR) AS n, CAST((7 * doc_id + 3) % 1000 AS VARCHAR) AS t, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '([\\`*_\[\]<>])', '\\\1', 'g'), '[ \t\r]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents),
md AS (SELECT d.lang AS scope_id, d.n AS page_id, d.doc_id, '## Page ' || d.n || ' & co' || chr(10) || chr(10) || CASE WHEN len(d.lines) > 0 THEN array_to_string(d.lines, chr(10) || chr(10)) || chr(10) || chr(10) ELSE '' END
  || '[out **there**](https://x.example/' || d.n || '?a=1&b=2)<!--gfl:meta title="t"--> [see it](' || CASE WHEN e.doc_id IS NULL THEN 'https://wiki/spaces/S/pages/' || d.t ELSE 'page-' || d.t || '.md' END || ')' || chr(10) || chr(10)
  || '![f' || d.n || '](../_attachments/' || d.lang || '/page-' || d.n || '/f' || d.n || '.png)<!--gfl:meta ac:width="' || d.doc_id % 100 || '"-->' || chr(10) || chr(10)
  || '- [' || CASE WHEN d.doc_id % 2 = 0 THEN 'x' ELSE ' ' END || '] do *' || d.n || '*' || chr(10) || chr(10) || '| k | v |' || chr(10) || '| --- | ---: |' || chr(10) || '| ' || d.n || ' |  |' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || '```python' || chr(10) || 'x < ' || d.n || chr(10) || '```' || chr(10) || chr(10) || '> [!' || CASE WHEN d.doc_id % 3 = 0 THEN 'INFO' ELSE 'ERROR' END || ']<!--gfl:meta title="T' || d.n || '"-->' || chr(10) || '> mind ' || d.n || chr(10) AS md
  FROM d LEFT JOIN d e ON e.n = d.t AND e.lang = d.lang)
"""


@query(f"WITH {MD} SELECT scope_id, page_id, CASE WHEN doc_id % 50 <> 7 THEN sha256(md) END AS md FROM md")
def storage_to_markdown(spark, sf_dir):
    return _converted(spark, sf_dir).select("scope_id", "page_id", F.sha2("md", 256).alias("md"))


@query(f"""WITH {MD} SELECT scope_id, page_id, sha256('---\nconfluence_page_id: "' || page_id || '"\nconfluence_version: ' || (doc_id % 7 + 1) || '\n---\n\n' || md) AS content FROM md WHERE doc_id % 50 <> 7""")
def render_pages(spark, sf_dir):
    from doctree.operators.convert import render_pages as render

    return render(_converted(spark, sf_dir)).select("scope_id", "page_id", F.sha2("content", 256).alias("content"))


@query("SELECT lang AS scope_id, CAST(doc_id AS VARCHAR) AS page_id FROM documents WHERE doc_id % 50 = 7")
def conversion_errors(spark, sf_dir):
    from doctree.operators.convert import conversion_errors as errors

    return errors(_converted(spark, sf_dir)).select("scope_id", "page_id")


# --- whole workloads --------------------------------------------------------------------------------


@query(CAT + r"""SELECT scope_id, page_id, path, sha256('---' || chr(10) || 'confluence_page_id: "' || page_id || '"' || chr(10) || 'confluence_version: ' || version || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(title, '([\\`*_\[\]<>])', '\\\1', 'g') || chr(10)) AS content FROM t JOIN paths USING (scope_id, page_id)""")
def export_scope(spark, sf_dir):
    from doctree.operators.export import export_scope as export

    pages = catalog(spark, sf_dir).withColumn("body", F.concat(F.lit("<p>"), tx.xml_escape(F.col("title")), F.lit("</p>")))
    return export(pages, roots(pages), "docs", text_ids=False).select("scope_id", "page_id", "path", F.sha2("content", 256).alias("content"))


@query(
    PLAN
    + """SELECT scope_id, page_id, path, CAST(version AS INT) AS version FROM t JOIN paths USING (scope_id, page_id)
UNION ALL SELECT scope_id, page_id, path, version FROM m WHERE page_id NOT IN (SELECT page_id FROM t) AND CAST(page_id AS BIGINT) % 3 <> 1 AND path NOT IN (SELECT path FROM paths)"""
)
def apply_pull_plan(spark, sf_dir):
    """A lagging mirror with its plan applied holds what the tree holds, and files of pages that a registry still knows, or can't
    tell about."""
    tree, paths, files = mirror(spark, sf_dir)
    files = work_table(files, "files")
    plan = work_table(sy.plan_pull(tree, paths, sy.scan_managed_files(files, "docs")), "plan")
    lost = sy.classify_missing(plan, _registry(files))
    plan = plan.select("scope_id", "page_id", "action", "from_path", "to_path").unionByName(lost.withColumn("to_path", F.lit(None).cast("string")))
    content = fm.apply_front_matter(fm.front_matter(F.col("page_id"), F.col("version")), F.lit("Body.\n"))
    done = sn.apply_pull_plan(files, plan, tree.select("scope_id", "page_id", content.alias("content")))
    return sy.scan_managed_files(done, "docs").select("scope_id", "page_id", "path", "version")


@query(
    GEO
    + f""", hand AS ({HAND_NAMED}), every AS (SELECT scope_id, path FROM paths UNION ALL SELECT scope_id, path FROM hand)
SELECT scope_id, path, 'shared' AS problem FROM every GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT scope_id, path, 'unsafe' FROM every WHERE NOT regexp_full_match(path, 'docs(/[a-z0-9-]+)+[.]md')"""
)
def audit_paths(spark, sf_dir):
    paths = hi.paths_of(tree_of(geo(spark, sf_dir)), "docs").unionByName(hand_named(spark, sf_dir))
    return hi.audit_paths(work_table(paths, "paths"), "docs")


@query("SELECT lang AS scope_id, 'docs/' || lang || '/p' || doc_id % 50 || '.md' AS path, 'f' || doc_id % 7 || '.png' AS filename, 'docs/_files/' || (max(doc_id) % 3) || '/f' || doc_id % 7 || '.png' AS file FROM documents WHERE doc_id % 5 <> 0 GROUP BY lang, doc_id % 50, doc_id % 7")
def referenced_attachments(spark, sf_dir):
    """Images by document; several documents share a page, and the last reference of a name wins."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("doc_id")
    name = F.concat((n % 3).cast("string"), F.lit("/f"), (n % 7).cast("string"), F.lit(".png"))
    src = F.when(n % 5 == 0, F.concat(F.lit("https://x.example/"), name)).when(n % 2 == 0, F.concat(F.lit("../_files/"), name)).otherwise(F.concat(F.lit("docs/_files/"), name))
    path = F.concat(F.lit("docs/"), "lang", F.lit("/p"), (n % 50).cast("string"), F.lit(".md"))
    return li.referenced_attachments(d.select(F.col("lang").alias("scope_id"), path.alias("path"), n.alias("ordinal"), src.alias("src")), "docs/_files")


@query("SELECT c_mktsegment AS scope_id, 'docs/_files/a' || c_custkey AS from_dir, 'docs/_files/b/a' || c_custkey AS to_dir FROM customer WHERE c_custkey % 2 = 1")
def attachment_moves(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = F.col("c_custkey").cast("string")
    flat = F.concat(F.lit("docs/a"), n, F.lit(".md"))
    to = F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("docs/b/a"), n, F.lit("/index.md"))).otherwise(F.concat(F.lit("docs/a"), n, F.lit("/index.md")))
    return sy.attachment_moves(c.select(F.col("c_mktsegment").alias("scope_id"), flat.alias("from_path"), to.alias("to_path")), "docs/", "docs/_files")


@query("SELECT c_mktsegment AS scope_id, 'p' || c_custkey AS from_path, 'p' || (c_custkey + 10) AS to_path FROM customer WHERE EXISTS (SELECT 1 FROM customer o WHERE o.c_mktsegment = customer.c_mktsegment AND o.c_custkey = customer.c_custkey + 10)")
def rename_collisions(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    p = lambda x: F.concat(F.lit("p"), x.cast("string"))
    return sy.rename_collisions(c.select(F.col("c_mktsegment").alias("scope_id"), p(F.col("c_custkey")).alias("from_path"), p(F.col("c_custkey") + 10).alias("to_path"))).select("scope_id", "from_path", "to_path")


@query("SELECT o_orderpriority AS scope_id, count(*) FILTER (o_orderstatus NOT IN ('O', 'P')) = 0 AS noop FROM orders GROUP BY ALL")
def plan_is_noop(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    action = F.when(F.col("o_orderstatus") == "O", "orphaned").when(F.col("o_orderstatus") == "P", "unknown").otherwise("update")
    return sy.plan_is_noop(o.select(F.col("o_orderpriority").alias("scope_id"), action.alias("action")))


@query(CAT + "SELECT scope_id, page_id, parent_page_id FROM t")
def parent_pages(spark, sf_dir):
    """The directories of a full export lead back to the tree's parents."""
    return sy.parent_pages(work_table(hi.paths_of(tree_of(catalog(spark, sf_dir)), "docs"), "paths"), "docs")
