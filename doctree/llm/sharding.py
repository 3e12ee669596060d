"""Sharding by extendible hashing. DataFrame functions only.

A directory is indexed by the first bits of a document's hash. Only buckets above the byte limit
split, on one more bit each time, until all fit; a bucket that holds one document (or only rows with one
hash) cannot split and is marked. The directory has so many bits that it holds at most four slots a shard: several slots may point
to one shard, and a slot to several deeper ones. Documents find their shard by an equi-join on the slot and the shard's span of hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of, work_table

SHARD_BYTES = 4 << 20
STRIDE = 8
MAX_BITS = 62


def hashed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bytes, nth, h): rows that agree in id and text get an ordinal, so that they too spread."""
    text = text_of(df, text_col)
    rows = df.select(df[id_col].alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("content"))
    rows = rows.groupBy("doc_id", "bytes", "content").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.select("doc_id", "bytes", "content", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"))
    return rows.select("doc_id", "bytes", "nth", F.shiftrightunsigned(F.xxhash64("doc_id", "content", "nth"), 64 - MAX_BITS).alias("h"))


def _top(h, bits: int):
    return F.shiftright(h, MAX_BITS - bits)


def split_buckets(rows: DataFrame, limit: int = SHARD_BYTES, stride: int = STRIDE) -> DataFrame:
    """(prefix, depth, bytes, docs, oversized): the leaves of the directory.

    A round sums the bytes of the buckets still too large under ``stride`` more bits, and rolls those
    sums up bit by bit: a bucket is a shard if it fits and the bucket it was split from doesn't.
    Rounds go on only while some bucket is above the limit and can split.
    """
    base, leaves, live = 0, None, rows.select("h", "bytes")
    while base < MAX_BITS:
        deep = min(base + stride, MAX_BITS)
        fine = live.groupBy(_top(F.col("h"), deep).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        levels = fine.select(F.explode(F.sequence(F.lit(base if base == 0 else base + 1), F.lit(deep))).alias("depth"), "prefix", "bytes", "docs", "lo", "hi")
        up = F.expr(f"shiftright(prefix, {deep} - depth)")
        sums = levels.groupBy("depth", up.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        sums = sums.withColumn("done", (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")))
        sums = work_table(sums, "buckets")
        parents = sums.where("not done").select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        first = 0 if base == 0 else base + 1
        fit = sums.where("done").join(parents, ["depth", "prefix"], "left_semi").unionByName(sums.where(F.col("done") & (F.col("depth") == first)).select(*sums.columns))
        # At the first level of a round every bucket's parent was too large; below it the parent decides.
        fit = fit.dropDuplicates(["depth", "prefix"]).select("prefix", "depth", "bytes", "docs", (F.col("bytes") > limit).alias("oversized"))
        leaves = fit if leaves is None else leaves.unionByName(fit)
        large = sums.where((F.col("depth") == deep) & ~F.col("done")).select("prefix")
        if deep == MAX_BITS or large.isEmpty():
            break
        live = live.join(large.withColumnRenamed("prefix", "p"), _top(F.col("h"), deep) == F.col("p"), "left_semi")
        base = deep
    return leaves


def directory_bits(depths: dict[int, int]) -> int:
    """How many bits of the hash index the directory, from the number of leaves of each depth: as many as leave it at four slots
    a leaf at most."""
    bits, total = 0, sum(depths.values())
    while total and bits < MAX_BITS and sum(n << max(0, bits + 1 - d) for d, n in depths.items()) <= 4 * total:
        bits += 1
    return bits


def directory(leaves: DataFrame, bits: int) -> DataFrame:
    """The leaves with ``slot``, ``lo`` and ``hi``: one row for each slot of a directory of ``bits`` bits that a leaf covers or lies
    in, and the hashes that are the leaf's."""
    span = F.expr(f"CASE WHEN depth <= {bits} THEN sequence(shiftleft(prefix, {bits} - depth), shiftleft(prefix + 1, {bits} - depth) - 1) ELSE array(shiftright(prefix, depth - {bits})) END")
    lo, hi = F.expr(f"shiftleft(prefix, {MAX_BITS} - depth)"), F.expr(f"shiftleft(prefix + 1, {MAX_BITS} - depth) - 1")
    return leaves.select(F.explode(span).alias("slot"), *leaves.columns, lo.alias("lo"), hi.alias("hi"))


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: doc_id, bytes, shard (bits of its prefix), depth, shard_bytes, shard_docs, oversized.

    A shard's texts sum to ``limit`` bytes at most, unless one document alone is larger: such a shard
    holds that document only and is ``oversized``. Null text has 0 bytes, null ids are hashed by their
    text, repeated rows spread like others, an empty table gives an empty result.
    """
    rows = work_table(hashed(df, id_col, text_col), "hashes")  # texts are read once, not again in each round
    leaves = work_table(split_buckets(rows, limit), "leaves")
    depths = {r["depth"]: r["count"] for r in leaves.groupBy("depth").count().collect()}  # at most MAX_BITS + 1 numbers
    bits = directory_bits(depths)
    told = ["prefix", "depth", "shard_bytes", "shard_docs", "oversized"]
    slots = directory(leaves.withColumnsRenamed({"bytes": "shard_bytes", "docs": "shard_docs"}), bits)
    placed = rows.select("doc_id", "bytes", "h", _top(F.col("h"), bits).alias("slot"))
    found = placed.join(slots, "slot").where(F.col("h").between(F.col("lo"), F.col("hi"))).select("doc_id", "bytes", *told)
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return found.select("doc_id", "bytes", name.alias("shard"), "depth", "shard_bytes", "shard_docs", "oversized")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``. Nulls, repeated rows, empty tables: see shard."""
    return shard(read_table(spark, sf_dir, "documents"))
