"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes what the one before kept, written as Parquet and read again, and decides over all of
it; all but the last return the columns of documents, extra ones included, whatever their names.

In every stage a null or blank text is a text without words, an id may be null or repeated, other columns may be
null, and an empty table gives an empty one. What each stage does with such rows is said at its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from doctree.llm.common import BATCH_ROWS, read_table, work_table


def bound_batches(spark: SparkSession) -> None:
    """From here on the session hands at most BATCH_ROWS rows at once to Python workers: a stage's result is evaluated
    after its function has returned, and texts of the usual 10,000 rows are much of a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay. Labels are those of the rows that aren't held out. Null and blank
    texts have no evidence, and equal texts share a score: all their rows stay or all go."""
    bound_batches(spark)
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays: the longest original text, then the smallest id, null ids last. Null and blank
    texts are equal, so one of them stays; rows alike in id and text are copies."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the smallest id stays, null ids last; one row of those repeated with that id. Null
    and blank texts are near nothing and stay."""
    bound_batches(spark)
    return near_dedup.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to the sources' target weights: a document comes as often as its words are taken. Null and blank texts have no
    words and don't come; null is a source of its own, the last."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a packed sequence. A null or blank text is one token, a repeated row a document of its own."""
    bound_batches(spark)
    packed = packing.pack(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "capacity")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained scores and signatures can't be put in SQL; tests hold what each stage keeps against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work_table(stage(spark, docs, sf_dir), name)
    return docs
