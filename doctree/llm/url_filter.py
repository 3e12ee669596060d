"""URL filters: host-suffix and path-prefix expressions, joined to the rules on short hash prefixes.

DataFrame functions only. A URL fits a rule if some suffix of its host (cut at dots) and some prefix of
its path are the rule's. Only suffixes with as many labels, and prefixes as long, as some rule has can
fit, so those alone are listed. The expression's digest is cut to a short prefix for the equi-join;
the full digest then confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

PREFIX_HEX = 8
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\u0000"), path)


def match_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    ``rules`` has verdict, host and path. The longest fitting rule (host and path together) wins; of
    equally long ones the longer host, then block. Without a fitting rule: null and ``default``. Null
    URLs, and those without ://, have an empty host and path. Repeated rows are all answered. Empty
    tables of URLs or rules are fine.
    """
    rule = rules.select(
        F.col("verdict").alias("r_verdict"), F.col("host").alias("r_host"), F.col("path").alias("r_path"),
        F.sha2(_expression(F.col("host"), F.col("path")), 256).alias("r_digest"),
    ).withColumn("r_prefix", F.left("r_digest", F.lit(PREFIX_HEX)))
    # Which label counts and path lengths occur among the rules: one row, two short arrays.
    shape = rules.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")
    )
    url = df[url_col].cast("string")
    pages = df.select(df[id_col].alias("page_id"), url.alias("url")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("times"))
    pages = pages.select("page_id", "url", "times", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    hosts = F.transform(
        F.filter("labels", lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    )
    paths = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.left("path", n))
    spread = pages.join(F.broadcast(shape), F.lit(True)).select("page_id", "url", hosts.alias("hosts"), paths.alias("paths"))
    spread = spread.select("page_id", "url", F.explode("hosts").alias("e_host"), "paths")
    spread = spread.select("page_id", "url", "e_host", F.explode("paths").alias("e_path"))
    spread = spread.withColumn("digest", F.sha2(_expression(F.col("e_host"), F.col("e_path")), 256)).withColumn("prefix", F.left("digest", F.lit(PREFIX_HEX)))
    fits = spread.join(rule, F.col("prefix") == F.col("r_prefix")).where(
        (F.col("digest") == F.col("r_digest")) & (F.col("e_host") == F.col("r_host")) & (F.col("e_path") == F.col("r_path"))
    )
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("long"), F.length("r_host").alias("host_long"), (F.col("r_verdict") == "block").alias("blocks"),
        F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
    )
    best = fits.groupBy("page_id", "url").agg(F.max(rank).alias("best"))
    p, b = pages.alias("p"), best.alias("b")
    judged = p.join(b, F.col("p.page_id").eqNullSafe(F.col("b.page_id")) & F.col("p.url").eqNullSafe(F.col("b.url")), "left")
    judged = judged.select("p.page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"))
    return judged.drop("nth")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``. Null urls, repeated rows, empty tables: see match_urls."""
    return match_urls(read_table(spark, sf_dir, "pages"), rule_table(spark))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.*, r.verdict, r.h || r.q AS rule,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.h || r.q) DESC, length(r.h) DESC) AS n
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
