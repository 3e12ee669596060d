"""Spelling variants by Aho-Corasick halves.

Two words that differ by one edit agree in one half: if a word is cut into two segments, the edit leaves the first at the
other word's beginning or the second at its end. Segments are dealt to shards by hash. Each shard builds one automaton
over the segments it holds and scans the words that could hold one of them (a word has at most six places where a segment
of a compatible length can stand). A hit counts where its offset fits the segment's side and the lengths differ by
one at most, and the distance is then verified.

A segment that very many words hold is no shard's matter: its words are joined on (segment, what stays of the other half
when one code point is left out). Such a key is shared by words one or two edits apart only, so no group is large.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of, work_table

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE = 199
LEAST_POINTS = 6
LEAST_COUNT = 5
RATIO = 5
#: Words of a shard, about; more words make more shards.
SHARD_WORDS = 8192
#: A segment that more words hold (or four times as many look up) goes through the join.
HOT = 2048
#: Up to so many words under one segment are compared one by one; more are looked up by what one deletion leaves.
FEW = 12


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of ``least_points`` code points and ``least_count`` occurrences at least.

    Where ``damage`` divides h, the crc32 of "<id>:<run>", the run's code point h % length is left out (0: none is).
    Null and blank texts have no words, a null id counts as an empty one, repeated rows count each time, an empty
    table gives an empty result; other columns are ignored. Counts are combined before they are shuffled.
    """
    runs = F.regexp_extract_all(text_of(df, text_col), F.lit(f"{LETTERS}{{{least_points},}}"), F.lit(0))
    rows = df.select(F.coalesce(df[id_col].cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("word"))
    if damage:
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        at = F.pmod(h, F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        rows = rows.select(F.when(h % damage == 0, less).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_points)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _halves(points: Column, size: Column) -> Column:
    """Of a word of ``points`` code points, its segment and its rest on either side, as a word of ``size`` would be cut."""
    first, last = F.floor(size / 2).cast("int"), (size - F.floor(size / 2)).cast("int")
    word = F.col("word")
    return F.array(
        F.struct(F.lit(0).alias("side"), F.substring(word, F.lit(1), first).alias("segment"), F.substring(word, first + 1, points).alias("rest")),
        F.struct(F.lit(1).alias("side"), F.substring(word, points - last + 1, points).alias("segment"), F.substring(word, F.lit(1), points - last).alias("rest")),
    )


def _segments(words: DataFrame) -> DataFrame:
    """(word, n, points, size, side, segment, rest): both halves of every word."""
    rows = words.select("word", "n", F.length("word").alias("points")).withColumn("size", F.col("points"))
    return rows.select("word", "n", "points", "size", F.inline(_halves(F.col("points"), F.col("size"))))


def _lookups(words: DataFrame, least_points: int) -> DataFrame:
    """The same for every segment that a word one edit away could have: sizes one less to one more."""
    points = F.length("word")
    rows = words.select("word", "n", points.alias("points"), F.explode(F.sequence(F.greatest(points - 1, F.lit(least_points)), points + 1)).alias("size"))
    return rows.select("word", "n", "points", "size", F.inline(_halves(F.col("points"), F.col("size"))))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point lies between the words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class _Posting:
    """The words of one length that hold one segment on one side."""

    def __init__(self, side: int, cut: int, size: int):
        self.side, self.cut, self.size, self.words, self.gaps = side, cut, size, [], None

    def rest(self, word: str) -> str:
        return word[self.cut :] if self.side == 0 else word[: len(word) - self.cut]

    def candidates(self, word: str) -> set[int]:
        """Numbers of the posting's words that may be one edit away."""
        if len(self.words) <= FEW:
            return set(range(len(self.words)))
        if self.gaps is None:
            self.gaps = defaultdict(list)
            for k, w in enumerate(self.words):
                r = self.rest(w)
                for gap in {r, *(r[:i] + r[i + 1 :] for i in range(len(r)))}:
                    self.gaps[gap].append(k)
        r = self.rest(word)
        keys = {r} if len(word) < self.size else {r[:i] + r[i + 1 :] for i in range(len(r))}
        return {k for key in keys for k in self.gaps.get(key, ())}


def scan_shard(held: pd.DataFrame, looked: pd.DataFrame) -> Iterator[tuple[str, str]]:
    """(word, near) by one automaton over the segments in ``held`` (word, side, segment), for all words of ``looked``."""
    import ahocorasick

    postings: dict[str, dict[tuple[int, int], _Posting]] = defaultdict(dict)
    for word, side, segment in zip(held["word"], held["side"], held["segment"], strict=True):
        key = (side, len(word))
        if key not in postings[segment]:
            postings[segment][key] = _Posting(side, len(segment), len(word))
        postings[segment][key].words.append(word)
    automaton = ahocorasick.Automaton()
    for segment, found in postings.items():
        automaton.add_word(segment, (len(segment), list(found.values())))
    automaton.make_automaton()
    for word in looked["word"]:
        points = len(word)
        for end, (size, found) in automaton.iter(word):
            begins, ends = end + 1 == size, end + 1 == points
            if not begins and not ends:
                continue
            for p in found:
                if (begins if p.side == 0 else ends) and abs(p.size - points) <= 1:
                    cut = p.size // 2  # pairs that agree in their first halves were found by those
                    for k in p.candidates(word):
                        near = p.words[k]
                        if one_edit(word, near) and (p.side == 0 or word[:cut] != near[:cut]):
                            yield word, near


def _scanned(held: DataFrame, looked: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("side", "segment"), F.lit(shards)).cast("int").alias("shard")
    held = held.select(shard, "word", "side", "segment")
    looked = looked.select(shard, "word").distinct()

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(scan_shard(a, b), columns=["word", "near"])

    return held.groupBy("shard").cogroup(looked.groupBy("shard")).applyInPandas(run, "word string, near string")


def _joined(held: DataFrame, looked: DataFrame) -> DataFrame:
    """(word, near) of hot segments, by what one deletion leaves of the rest."""
    gaps = F.transform(F.sequence(F.lit(1), F.length("rest")), lambda i: F.concat(F.substring("rest", F.lit(1), i - 1), F.substring("rest", i + 1, F.length("rest"))))
    placed = F.transform(gaps, lambda g, i: F.concat_ws(":", F.lit("same"), i, g))
    key = lambda kind, x: F.transform(F.array_distinct(x), lambda g: F.concat_ws(":", F.lit(kind), g))
    whole = F.array("rest")
    own = F.concat(key("more", whole), placed, key("less", gaps))
    mine = F.when(F.col("points") > F.col("size"), key("more", gaps)).when(F.col("points") == F.col("size"), placed).otherwise(key("less", whole))
    at = ["side", "segment", "size", "key"]
    a = held.select("side", "segment", "size", F.col("word").alias("near"), F.explode(own).alias("key"))
    b = looked.select("side", "segment", "size", "word", F.explode(mine).alias("key"))
    cut = F.floor(F.col("size") / 2).cast("int")
    again = (F.col("side") == 1) & (F.substring("word", F.lit(1), cut) == F.substring("near", F.lit(1), cut))
    return b.join(a, at).where((F.col("word") != F.col("near")) & ~again).select("word", "near")


def near_words(words: DataFrame, least_points: int = LEAST_POINTS, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(word, near): all ordered pairs of ``words`` (word, n; words unique) one edit apart, each once.

    No pair is lost to frequent segments, and a word has few hundred partners at most (one edit over the letters in use).
    """
    held, looked = work_table(_segments(words), "segments"), work_table(_lookups(words, least_points), "lookups")
    at = ["side", "segment"]
    count = lambda d, a, b: d.groupBy(*at).agg(F.count(F.lit(1)).alias("rows")).select(*at, F.col("rows").alias(a), F.lit(0).cast("long").alias(b))
    sides = count(held, "held", "looked").unionByName(count(looked, "looked", "held")).groupBy(*at).agg(F.sum("held").alias("held"), F.sum("looked").alias("looked"))
    met = sides.where("held > 0 and looked > 1").select(*at, ((F.col("held") > hot) | (F.col("looked") > 4 * hot)).alias("hot"))
    met = work_table(met, "met")
    shards = max(1, -(-words.count() // shard_words))
    pick = lambda d, flag: d.join(met.where(F.col("hot") == flag).select(*at), at)
    return _scanned(pick(held, False), pick(looked, False), shards).unionByName(_joined(pick(held, True), pick(looked, True)))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms (word, form), by pointer doubling. A form is more frequent than
    its word, so chains end, after as many steps as counts can grow by a factor."""
    ways = work_table(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ways.join(ahead, "root", "left_semi").isEmpty():
            return ways
        ways = work_table(ways.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "ways")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, damage: int = 0, ratio: int = RATIO, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row a word of word_counts.

    ``form`` is the near word of largest n, of equal ones the first in code-point order, if it is ``ratio`` times as frequent
    at least; ``root`` the last form of the chain. Nulls, repeated rows and empty tables: see word_counts.
    """
    words = work_table(word_counts(df, id_col, text_col, least_points, least_count, damage), "words")
    pairs = near_words(words, least_points, shard_words, hot)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), "near")).alias("best")
    told = pairs.join(known, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = words.join(told, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.neg") >= F.col("n") * ratio, F.col("best")).alias("best"))
    rows = work_table(rows.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.neg")).alias("form_n")), "variants")
    roots = follow(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, with the contract's deletions. Null and blank texts give no words; an empty table no rows."""
    return spelling_variants(read_table(spark, sf_dir, "documents"), damage=DAMAGE)
