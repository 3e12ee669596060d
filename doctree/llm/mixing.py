"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

A source's documents, in a seeded order, form a stream of words that repeats after its end; the
stream is cut into blocks of equally many words. The mix is a row of shards of equally many blocks.
Each shard's seats go to the highest quotients target / (2 k + 1), so it gets an integer quota of
blocks of each source: those between the source's seats in the house that ends before the shard and in
the house that ends with it. A shard takes its quota as the next blocks of the source's seeded stream, from a
seeded start on; what a document gives is what the shards take of its place in the stream. No block or
word becomes a row: the widest table has a narrow row for each time a document comes and each shard that
may take from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read_table, text_of, work_table

BLOCK_WORDS = 16
SHARD_BLOCKS = 1 << 16
MAX_EPOCHS = 3
#: Documents of one source that are summed in one task, about.
LANE_ROWS = 100_000
SEED = 20


def _key(value: F.Column) -> F.Column:
    """A text for joins: null is no other value."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, tie): words in the text, null text 0; a hash that tells rows with one id apart by their text."""
    text = text_of(df, text_col)
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return df.select(df[id_col].alias("doc_id"), df[source_col].cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("tie"))


def source_targets(sized: DataFrame, weight_cycle: int = 3, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: source, source_size, weight, target.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes. A
    target stops at ``max_epochs`` times its source's size; the excess is shared again by weight.
    That process ends where the sources with the smallest size per weight are capped and the others
    share the rest at one rate: windows over the sources find it. The windows see one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % weight_cycle + 1).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("rate", left / weights)
    # Capping the sources in this order raises the rate up to the right number of capped ones and lowers it after.
    per = per.withColumn("rate", F.max("rate").over(everything))
    target = F.least("cap", F.coalesce(F.col("rate") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def shard_quotas(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, source, low, high, quota): blocks of each source in each shard, by Sainte-Laguë's method; low to high are
    the blocks' numbers among all of the source's.

    A house of n seats gives source s about n t_s / T seats. With S sources the right divisor is so
    near T / n that the seats differ from that by at most S t_s / (2 T) + 1, so only the quotients in
    that span compete; all below the span are won. A shard's houses hold a few rows a source.
    """
    whole = targets.agg(F.sum("target").alias("total"), F.count(F.lit(1)).alias("sources"))
    blocks = F.floor(F.col("total") / block_words + 0.5)
    shards = whole.withColumn("blocks", blocks).where("blocks > 0").select(
        "total", "sources", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / shard_blocks))).alias("shard")
    )
    ends = F.array(F.col("shard") * shard_blocks, F.least("blocks", (F.col("shard") + 1) * shard_blocks))
    houses = shards.select("total", "sources", "shard", F.posexplode(ends).alias("last", "seats"))
    # The targets have one row a source and are joined to each house: this lists the quotas asked for.
    listed = targets.where("target > 0").agg(F.collect_list(F.struct("source", "target")).alias("all"))
    rows = houses.join(listed, F.lit(True), "inner").select("total", "sources", "shard", "last", "seats", F.explode("all").alias("s"))
    share = F.col("s.target") / F.col("total")
    about, spread = F.floor(F.col("seats") * share + 0.5), F.ceil(F.col("sources") * share / 2) + 2
    rows = rows.select(
        "shard", "last", "seats", F.col("s.source").alias("source"), F.col("s.target").alias("target"),
        F.greatest(about - spread, F.lit(0)).alias("sure"), (about + spread).alias("most"),
    )
    house = Window.partitionBy("shard", "last")
    sure = rows.groupBy("shard", "last", "seats").agg(F.sum("sure").alias("won"))
    asked = rows.select("shard", "last", "source", "target", "sure", F.explode(F.sequence("sure", "most")).alias("k"))
    rank = F.row_number().over(house.orderBy(F.desc(F.col("target") / (2 * F.col("k") + 1)), F.col("source").isNull(), "source", "k"))
    won = asked.withColumn("rank", rank).join(sure, ["shard", "last"]).where(F.col("rank") <= F.col("seats") - F.col("won"))
    extra = won.groupBy("shard", "last", "source").agg(F.count(F.lit(1)).alias("extra"))
    seats = rows.select("shard", "last", "source", "sure", F.lit(0).cast("long").alias("extra")).unionByName(extra.withColumn("sure", F.lit(0).cast("long")).select("shard", "last", "source", "sure", "extra"))
    held = F.col("sure") + F.col("extra")
    of = lambda last: F.sum(F.when(F.col("last") == last, held).otherwise(0)).cast("long")
    ranges = seats.groupBy("shard", "source").agg(of(0).alias("low"), of(1).alias("high"))
    return ranges.withColumn("quota", F.col("high") - F.col("low"))


def place(sized: DataFrame, seed: int = SEED, lane_rows: int = LANE_ROWS) -> DataFrame:
    """(doc_id, source, size, tie, first): each document's place in its source's seeded stream.

    The stream order is that of a hash; hash lanes, as many as the rows need, are summed apart and then strung
    together, so a source with a third of all rows is summed in many tasks.
    """
    lanes = max(16, -(-sized.count() // lane_rows))
    order = F.xxhash64(F.lit(seed), "doc_id", "size", "tie")
    lane = F.pmod(F.shiftrightunsigned(order, 24), F.lit(lanes))
    rows = sized.where("size > 0").select("doc_id", "source", "size", "tie", order.alias("at"), lane.alias("lane"))
    sums = rows.groupBy("source", "lane").agg(F.sum("size").alias("lane_size"))
    strung = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("lane").alias("l"), F.coalesce(F.sum("lane_size").over(strung), F.lit(0)).alias("lane_first"))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["lane"] == sums["l"]))
    inside = Window.partitionBy("source", "lane").orderBy("at", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("lane_first") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.select("doc_id", "source", "size", "tie", first.alias("first"))


def shard_pieces(placed: DataFrame, targets: DataFrame, quotas: DataFrame, seed: int, block_words: int, shard_blocks: int) -> DataFrame:
    """(source, first, lap, shard, skip, words): what each shard takes of each document, at place ``first`` of its
    source's stream, when the stream passes it the ``lap``-th time: ``words`` words after the first ``skip``.

    A source's n-th block is won in a house of about n T / t_s seats, off by S / 2 + 2 T / t_s at most (see
    shard_quotas), which names the few shards that may take from a place; an equi-join on source and
    shard then tells which ones do.
    """
    size = F.col("source_size")
    start = F.when(size > 0, F.floor(F.pmod(F.xxhash64(F.lit(seed), "source"), size) / block_words) * block_words).otherwise(0)
    whole = targets.agg(F.sum("target").alias("total"), F.count(F.lit(1)).alias("sources"))
    plan = targets.where("target > 0").join(whole, F.lit(True)).select(_key(F.col("source")).alias("src"), "source_size", start.alias("start"), (F.col("total") / F.col("target")).alias("seats_each"), "sources")
    rows = placed.select("source", "first", "size", _key(F.col("source")).alias("src")).join(plan, "src")
    laps = rows.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS))))
    # Places count from the source's start on; words before the start come with the last lap.
    at = F.col("first") + F.col("lap") * size - F.col("start")
    laps = laps.withColumn("at", at).where((F.col("at") + F.col("size") > 0) & (F.col("at") < MAX_EPOCHS * size))
    slack = F.col("sources") / 2 + 2 * F.col("seats_each") + 1
    shard = lambda word, off: F.floor(((word / block_words) * F.col("seats_each") + off) / shard_blocks)
    near = F.sequence(F.greatest(shard(F.col("at"), -slack), F.lit(0)), F.greatest(shard(F.col("at") + F.col("size"), slack), F.lit(0)))
    asked = laps.select("source", "first", "size", "source_size", "src", "lap", "at", F.explode(near).alias("shard"))
    taken = quotas.where("quota > 0").select(_key(F.col("source")).alias("src"), "shard", (F.col("low") * block_words).alias("low"), (F.col("high") * block_words).alias("high"))
    met = asked.join(taken, ["src", "shard"])
    low = F.greatest("at", "low")
    high = F.least(F.col("at") + F.col("size"), "high", MAX_EPOCHS * size)
    met = met.select("source", "first", "lap", "shard", (low - F.col("at")).alias("skip"), (high - low).alias("words"))
    return met.where("words > 0")


def plan_mix(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, block_words: int, shard_blocks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes with places, targets, pieces); documents without words have a null place."""
    sized = work_table(measure(df, id_col, text_col, source_col), "sizes")
    targets = work_table(source_targets(sized), "targets")
    placed = work_table(place(sized, seed), "places")
    quotas = work_table(shard_quotas(targets, block_words, shard_blocks), "quotas")
    pieces = shard_pieces(placed, targets, quotas, seed, block_words, shard_blocks)
    blank = sized.where("size = 0").select("doc_id", "source", "size", "tie", F.lit(None).cast("long").alias("first"))
    return placed.unionByName(blank), targets, pieces


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, first, taken, shards.

    ``first`` is the document's place in its source's stream (null without words); ``shards`` are the
    (shard, words) that take from it, and ``taken`` is their sum, repeats too, never above
    ``MAX_EPOCHS`` times the size. Null source is a source of its own and
    comes last; null or blank texts have size 0 and give nothing. Rows repeated with one id are
    documents of their own. An empty table gives an empty result. Reruns give the same.
    """
    placed, targets, pieces = plan_mix(df, id_col, text_col, source_col, seed, block_words, shard_blocks)
    by_shard = pieces.groupBy("source", "first", "shard").agg(F.sum("words").alias("words"))
    held = F.sort_array(F.collect_list(F.struct("shard", "words")))  # as many as the document's words can fill, and one more a lap
    told = by_shard.groupBy(_key(F.col("source")).alias("src"), "first").agg(F.sum("words").alias("taken"), held.alias("shards"))
    per = targets.select(_key(F.col("source")).alias("src"), "source_size", "target")
    rows = placed.withColumn("src", _key(F.col("source"))).join(told, ["src", "first"], "left").join(per, "src")
    none = F.array().cast("array<struct<shard:bigint,words:bigint>>")
    return rows.select("doc_id", "source", "size", "source_size", "target", "first", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself, with the input's columns: a document comes whole for each time that shards take all of its words
    in one lap, and cut to the taken words (joined by blanks) where the source's run of blocks begins or ends inside it.
    Null and blank texts don't come, a null source is one of its own, repeated rows are documents of their own and an empty
    table gives an empty mix.
    """
    placed, _, pieces = plan_mix(df, id_col, text_col, source_col, seed, BLOCK_WORDS, SHARD_BLOCKS)
    # A lap's pieces follow each other: the run of blocks has no gaps.
    laps = pieces.groupBy(_key(F.col("source")).alias("src"), "first", "lap").agg(F.min("skip").alias("skip"), F.sum("words").alias("words"))
    laps = laps.groupBy("src", "first").agg(F.sort_array(F.collect_list(F.struct("lap", "skip", "words"))).alias("laps"))  # MAX_EPOCHS + 1 at most
    keys = ["id", "src", "size", "tie"]
    named = placed.withColumn("src", _key(F.col("source"))).join(laps, ["src", "first"]).select(_key(F.col("doc_id")).alias("id"), "src", "size", "tie", "first", "laps")
    named = named.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("first")))
    text = text_of(df, text_col)
    rows = df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"), _key(df[id_col]).alias("id"), _key(df[source_col]).alias("src"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie"),
    )
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))  # rows alike in all of these are alike
    came = rows.join(named, [*keys, "nth"]).select("row", "size", F.explode("laps").alias("lap"))
    own = F.col(f"row.`{text_col}`")
    words = F.regexp_extract_all(own, F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("lap.skip") + 1).cast("int"), F.col("lap.words").cast("int")), " ")
    shown = F.when(F.col("lap.words") == F.col("size"), own).otherwise(cut)
    return came.select(*[shown.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; a null source is a source of its own. Nulls, repeated rows, empty tables: see mix."""
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
