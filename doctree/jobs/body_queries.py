"""Queries over bodies that nest, and their SQL: panels of the newer form, decisions, lists in lists, tables in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctree.functions.tables import work_table
from doctree.jobs.inputs import spark_input
from doctree.jobs.queries import query

_K = "CAST(c_custkey AS STRING)"
_TYPE = "CASE c_custkey % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'note' WHEN 2 THEN 'success' WHEN 3 THEN 'warning' ELSE 'error' END"
_STATE = "CASE WHEN c_custkey % 3 = 0 THEN 'DECIDED' ELSE 'UNDECIDED' END"
#: A panel with a list in a list, a decision, and a table with a table in its last cell; every seventh paragraph has no end tag.
NESTED_PAGES = f"""
SELECT c_mktsegment AS scope_id, {_K} AS page_id, CAST(1 AS INT) AS version, concat(
'<ac:adf-extension><ac:adf-node type="panel"><ac:adf-attribute key="panel-type">', {_TYPE}, '</ac:adf-attribute><ac:adf-content><p>c ', {_K}, '</p><ul><li>a<ul><li>b <em>', {_K}, '</em></li></ul></li><li>c</li></ul></ac:adf-content></ac:adf-node><ac:adf-fallback><p>old</p></ac:adf-fallback></ac:adf-extension>',
'<ac:adf-extension><ac:adf-node type="decision-list"><ac:adf-node type="decision-item"><ac:adf-attribute key="state">', {_STATE}, '</ac:adf-attribute><ac:adf-content>do ', {_K}, '</ac:adf-content></ac:adf-node></ac:adf-node></ac:adf-extension>',
'<table><tbody><tr><td>', {_K}, '</td><td>y<table><tr><td>in ', {_K}, '</td></tr></table></td></tr></tbody><thead><tr><th>h</th><th style="text-align: center">k</th></tr></thead></table>loose ', {_K}, CASE WHEN c_custkey % 7 = 0 THEN '<p>open <b>x' ELSE '<p>shut</p>' END) AS body FROM {{customer}}
"""


@query("""
SELECT c_mktsegment AS scope_id, CAST(c_custkey AS VARCHAR) AS page_id, k.label, k.state, k.kept, k.text FROM customer, LATERAL (
  SELECT CASE c_custkey % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'NOTE' WHEN 2 THEN 'SUCCESS' WHEN 3 THEN 'WARNING' ELSE 'ERROR' END AS label, NULL AS state, NULL AS kept, 'c ' || c_custkey || 'ab ' || c_custkey || 'c' AS text
  UNION ALL SELECT 'DECISION', CASE WHEN c_custkey % 3 = 0 THEN 'DECIDED' ELSE 'UNDECIDED' END, CASE WHEN c_custkey % 3 <> 0 THEN 'UNDECIDED' END, 'do ' || c_custkey) k
""")
def extract_newer_panels(spark, sf_dir):
    from doctree.operators.extract import extract_panels as extract

    found = extract(spark_input(spark, sf_dir, NESTED_PAGES))
    return found.select("scope_id", "page_id", "label", "state", F.try_element_at("meta", F.lit("state")).alias("kept"), "text")


@query("""
SELECT c_mktsegment AS scope_id, CAST(c_custkey AS VARCHAR) AS page_id, k.* FROM customer, LATERAL (VALUES
  (0, 0, 0, TRUE, NULL, 'h'), (0, 0, 1, TRUE, 'center', 'k'), (0, 1, 0, FALSE, NULL, CAST(c_custkey AS VARCHAR)), (0, 1, 1, FALSE, NULL, 'yin ' || c_custkey), (1, 0, 0, TRUE, NULL, 'in ' || c_custkey)) k(ordinal, row, col, header, align, text)
""")
def extract_nested_tables(spark, sf_dir):
    from doctree.operators.extract import extract_tables as extract

    return extract(spark_input(spark, sf_dir, NESTED_PAGES))


@query("""
SELECT c_mktsegment AS scope_id, CAST(c_custkey AS VARCHAR) AS page_id, k.* FROM customer, LATERAL (VALUES
  ('para', 'c ' || c_custkey), ('list', 'ab ' || c_custkey || 'c'), ('para', 'do ' || c_custkey), ('table', c_custkey || 'yin ' || c_custkey || 'hk'), ('para', 'loose ' || c_custkey),
  ('para', CASE WHEN c_custkey % 7 = 0 THEN 'open x' ELSE 'shut' END)) k(kind, text)
""")
def extract_nested_blocks(spark, sf_dir):
    """Blocks inside panels, loose text, a paragraph without an end tag."""
    from doctree.operators.extract import extract_blocks as extract

    return extract(spark_input(spark, sf_dir, NESTED_PAGES)).select("scope_id", "page_id", "kind", "text")


@query("""
SELECT c_mktsegment AS scope_id, CAST(c_custkey AS VARCHAR) AS page_id, '> [!' || CASE c_custkey % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'NOTE' WHEN 2 THEN 'SUCCESS' WHEN 3 THEN 'WARNING' ELSE 'ERROR' END || ']' || chr(10)
  || '> c ' || c_custkey || chr(10) || '>' || chr(10) || '> - a' || chr(10) || '>   - b *' || c_custkey || '*' || chr(10) || '> - c' || chr(10) || chr(10)
  || '> [!DECISION]' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '<!--gfl:meta state="UNDECIDED"-->' END || chr(10) || '> do ' || c_custkey || chr(10) || chr(10)
  || '| h | k |' || chr(10) || '| --- | :---: |' || chr(10) || '| ' || c_custkey || ' | yin ' || c_custkey || ' |' || chr(10) || chr(10) || 'loose ' || c_custkey || chr(10) || chr(10) || CASE WHEN c_custkey % 7 = 0 THEN 'open **x**' ELSE 'shut' END || chr(10) AS md
FROM customer
""")
def nested_to_markdown(spark, sf_dir):
    from doctree.operators.convert import storage_to_markdown as convert

    pages = work_table(spark_input(spark, sf_dir, NESTED_PAGES), "pages")
    paths = pages.select("scope_id", "page_id", F.concat(F.lit("docs/"), "page_id", F.lit(".md")).alias("path"))
    tree = pages.select("scope_id", "page_id", F.lit("t").alias("title"))
    return convert(pages, tree, tree.select("scope_id", "page_id", F.lit(0).alias("bfs_ord")), paths).select("scope_id", "page_id", "md")
