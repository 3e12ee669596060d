from pyspark.sql import functions as F

from doctree.llm import sharding


def test_the_directory_stays_in_proportion_to_its_leaves(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = sharding.hashed(df)
    leaves = sharding.work_table(sharding.split_buckets(rows, limit=16), "leaves")
    depths = {r["depth"]: r["count"] for r in leaves.groupBy("depth").count().collect()}
    assert max(depths) - min(depths) > 8
    slots = sharding.directory(leaves, sharding.directory_bits(depths))
    assert leaves.count() <= slots.count() <= 4 * leaves.count()
    got = sharding.shard(df, limit=16)
    assert got.count() == 3000 and got.where("shard_bytes > 16 and not oversized").isEmpty()
    sums = got.groupBy("shard", "shard_bytes", "shard_docs").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    assert sums.where("b <> shard_bytes or n <> shard_docs").isEmpty() and sharding.directory_bits({}) == 0
