"""Exact dedup by skew-safe combining.

Texts are equal when their contents are identical after white space is deleted. Work goes in three
rounds, each grouping on the *full content* and not just on its digest:

1. every input partition combines its own rows (the map side of the first aggregation);
2. groups of (digest, salt) combine over the cluster, so a text that a third of all rows repeat is
   still spread over ``salts`` tasks;
3. the salt winners, at most ``salts`` a text, combine to one winner a text.

The answer travels back the same way: text -> (text, salt) -> row, so the way back is as even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, read_table, text_of

SALTS = 64


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def sha256_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def _mark(df: DataFrame, id_col: str, text_col: str, salts: int, digest) -> DataFrame:
    text = text_of(df, text_col)
    content = normalised(text)
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("len"),
        digest(content).alias("digest"),
        F.pmod(F.xxhash64(df[id_col], F.length(text)), F.lit(salts)).cast("int").alias("salt"),
        content.alias("content"),
    )


def find_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256_digest) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    Of equal texts the row with the most code points stays, then the smallest id (a null id comes
    after all others). Null text counts as empty; all empty or blank texts are one group. Of rows
    repeated with the same id and text one is kept. An empty table gives an empty result; other
    columns are ignored, whatever their names. ``digest`` may be weak: contents are compared in
    full, and texts that share a digest stay apart.
    """
    marked = _mark(df, id_col, text_col, salts, digest)
    order = F.struct((-F.col("len")).alias("neg_len"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    salted = marked.groupBy("digest", "salt", "content").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "content").agg(
        F.min("best").alias("best"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("used")
    )
    # One content a digest, but for collisions; those are told apart by their content on the way back.
    whole = whole.select(
        "digest", "content", "used", F.col("best.doc_id").alias("keep_id"), (-F.col("best.neg_len")).alias("keep_len"), "group_size",
        F.xxhash64("content").alias("content_key"),
    )
    back = whole.select("digest", "content_key", "keep_id", "keep_len", "group_size", F.explode("used").alias("salt"))
    rows = marked.select("doc_id", "len", "digest", "salt", F.xxhash64("content").alias("content_key"))
    at = ["digest", "content_key", "salt"]
    joined = rows.join(back, at)
    first = F.row_number().over(Window.partitionBy(*at, "doc_id").orderBy(F.desc("len")))
    is_kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len")) & (first == 1)
    return joined.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), is_kept.alias("kept"), "digest")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without later copies, with the input's columns, whatever their names: of equal texts the row that
    find_duplicates marks as kept. A null id is an id of its own; of rows alike in id and text one stays. Null texts are
    empty ones; an empty table stays empty."""
    id_ = df[id_col].cast("long")
    key = lambda c: [c.isNull().alias("no_id"), F.coalesce(c, F.lit(0)).alias("key")]
    found = find_duplicates(df, id_col, text_col).where("kept").select(*key(F.col("doc_id")), "digest")
    content = normalised(text_of(df, text_col))
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *key(id_), sha256_digest(content).alias("digest"), F.length(text_of(df, text_col)).alias("len"))
    once = F.row_number().over(Window.partitionBy("no_id", "key", "digest").orderBy(F.desc("len")))
    return rows.join(found, ["no_id", "key", "digest"], "left_semi").withColumn("n", once).where("n = 1").select("row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; nulls, ties, repeated rows: see find_duplicates."""
    found = find_duplicates(read_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY content ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM w
"""
