"""Toxicity by noisy-channel deobfuscation.

A character language model is counted over all texts. Words that look disguised (digits or signs
among letters, letters set apart, runs of one letter) become a lattice of the characters that each sign may
stand for; Viterbi decoding under the language model picks the restored word. A text is scored by the
words of the text and of its restored words.

What a word, or its beginning, says about toxicity is learned from labelled documents. A word's evidence counts
independent documents: of all documents that hold a word after the same neighbour, or before the same
neighbour, only the first counts, so that near copies of one document are one piece of evidence.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, release_memory, text_of, work_table
from .textwords import Words, chunks

#: At most about so many labelled rows are learned from; they are picked by a hash of their id.
TRAIN_ROWS = 40_000
HELD_OUT = 5
#: Restored words that a task remembers.
CACHE = 1 << 16
#: A slice of texts takes about 600 bytes a word while it is read.
SLICE_BYTES = 1 << 18
LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHER, EDGE, SYMBOLS = 27, 0, 28
#: Features of a word: the word, and its first so many bytes.
BEGINNINGS = (4, 5, 6, 7, 8)
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "µ": "u"}
SEPARATORS = set(" .-_*~'`,/\\:;#^=\u200b\u00ad")
LEET_COST, KEEP_COST, DROP_COST, REPEAT_COST = 1.0, 4.0, 0.7, 0.7

RUNS = re.compile(r"(.)\1{2,}")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_IS_LETTER[128:] = True
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = OTHER
_LEET_BYTES = np.zeros(256, bool)
_LEET_BYTES[[ord(c) for c in LEET if ord(c) < 128]] = True
NOT_LETTERS = SEPARATORS | {c for c in LEET if not c.isalpha()}
APART = re.compile("[" + re.escape("".join(sorted(SEPARATORS))) + "]+")


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def character_counts(docs: DataFrame) -> DataFrame:
    """(code, n): counts of three symbols in a row, over all texts (not null; empty ones count nothing, repeated rows each time).
    Symbols: a-z, other letters, the rest. An empty table gives no counts."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in chunks(batch, limit=SLICE_BYTES):
                data, _ = _buffer(part.column(part.schema.get_field_index("text")))
                s = _SYMBOL[_LOWER[data]]
                if len(s) > 2:
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])
        release_memory()

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Costs (negative log probabilities) of a symbol after two others; SYMBOLS^3 numbers at most."""
    n = np.full(SYMBOLS**3, 0.2)
    for r in counts.collect():
        n[r["code"]] += r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return -np.log(n / n.sum(axis=2, keepdims=True))


def _symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return OTHER if c.isalpha() else EDGE


def restore(token: str, lm: list | np.ndarray) -> str:
    """The cheapest reading of a lower-case token: each character may stay, a sign may stand for a
    letter, a separator between characters may be dropped, and a letter that comes three times or more
    may be dropped down to one. Where separators stand between all characters, one or more, they are dropped."""
    single = [x for x in APART.split(token) if x]
    if len(single) > 2 and all(len(x) == 1 for x in single):
        token = "".join(single)
    runs = [m.span() for m in RUNS.finditer(token)]
    lattice: dict[tuple[int, int, str], tuple[float, str]] = {(EDGE, EDGE, ""): (0.0, "")}
    for i, c in enumerate(token):
        in_run = bool(runs) and any(a < i < b for a, b in runs)
        nxt: dict[tuple[int, int, str], tuple[float, str]] = {}

        def offer(key, cost, out, nxt=nxt):
            if key not in nxt or cost < nxt[key][0]:
                nxt[key] = (cost, out)

        for (a, b, last), (cost, out) in lattice.items():
            s = _symbol(c)
            offer((b, s, c), cost + lm[a][b][s] + (KEEP_COST if c in LEET else 0.0), out + c)
            for letter in LEET.get(c, ""):
                s = _symbol(letter)
                offer((b, s, letter), cost + lm[a][b][s] + LEET_COST, out + letter)
            if c in SEPARATORS and b != EDGE:
                offer((a, b, last), cost + DROP_COST, out)
            elif in_run and (c == last or last and last in LEET.get(c, "")):
                offer((a, b, last), cost + REPEAT_COST, out)
        lattice = nxt
    return min(((cost + lm[a][b][EDGE], out) for (a, b, _), (cost, out) in lattice.items()), default=(0.0, token))[1]


def _wide(d: np.ndarray, signs) -> np.ndarray:
    """Which bytes belong to those of the signs that take more than one."""
    flag = np.zeros(len(d), bool)
    for raw in (c.encode() for c in signs if ord(c) >= 128):
        at = np.flatnonzero(d == raw[0])
        at = at[at + len(raw) <= len(d)]
        for k in range(1, len(raw)):
            at = at[d[at + k] == raw[k]]
        for k in range(len(raw)):
            flag[at + k] = True
    return flag


def disguised(words: Words) -> np.ndarray:
    """Indexes of words that may hide another: signs or separators inside letters, or a letter three times."""
    d = words.data
    letter, leet = _IS_LETTER[d], _LEET_BYTES[d]
    triple = np.zeros(len(d), bool)
    if len(d) > 2:
        triple[2:] = letter[2:] & (d[2:] == d[1:-1]) & (d[1:-1] == d[:-2]) & (d[2:] < 128)
    mark = letter | leet
    if len(d) and d.max() >= 128:
        leet = leet | _wide(d, LEET)
        mark = (mark | leet) & ~_wide(d, SEPARATORS)
    begins = mark.copy()  # of runs of letters and signs; blanks stand between words
    begins[1:] &= ~mark[:-1]

    def each(flag):
        total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return total[words.end] - total[words.start]

    letters = each(letter)
    return np.flatnonzero((letters > 0) & ((each(leet) > 0) | (each(begins) > 1)) | (each(triple) > 0))


def spelled(words: Words) -> list[tuple[int, int]]:
    """Runs (first, last) of three or more words of one character in one text."""
    size = words.end - words.start
    single = (size == 1) | (size == 2)
    if not (single | (size == 3)).any():
        return []
    two = np.flatnonzero(size == 2)
    single[two] = words.data[words.start[two]] >= 0xC0  # one character of two bytes
    three = np.flatnonzero(size == 3)
    single[three] = words.data[words.start[three]] >= 0xE0
    same = np.zeros(len(single), bool)
    same[1:] = single[1:] & single[:-1] & (words.doc[1:] == words.doc[:-1])
    first = np.flatnonzero(single & ~same)
    last = np.flatnonzero(single & ~np.append(same[1:], False))
    return [(int(a), int(b)) for a, b in zip(first, last, strict=True) if b - a >= 2]


class Reader:
    """The words that texts are scored by: hashes of letter runs, in the texts and in their restored words."""

    def __init__(self, lm: np.ndarray):
        self.lm, self.known = lm.tolist(), {}  # lists are faster to read one by one

    def _restored(self, token: str) -> str:
        if token not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[token] = restore(token, self.lm)
        return self.known[token]

    def letters(self, texts: pa.Array) -> Words:
        """Letter runs of the texts, lower-case."""
        data, bounds = _buffer(texts)
        low = _LOWER[data]
        low[~_IS_LETTER[low] | _wide(low, NOT_LETTERS)] = 32
        return Words(_as_strings(low, bounds))

    def read(self, texts: pa.Array) -> "Found":
        """All words of the texts, of their restored words too, each with its beginnings."""
        data, bounds = _buffer(texts)
        plain = self.letters(texts)
        parts = [(plain, plain.doc)]
        raw = Words(_as_strings(_LOWER[data], bounds))
        spans = [(raw.start[i], raw.end[i], raw.doc[i]) for i in disguised(raw)] + [(raw.start[a], raw.end[b], raw.doc[a]) for a, b in spelled(raw)]
        if spans:
            whole = raw.data.tobytes()
            tokens = [whole[a:b].decode("utf-8", "replace") for a, b, _ in spans]
            other = [(x, s[2]) for t, s in zip(tokens, spans, strict=True) if (x := self._restored(t)) != t]  # words that stay as they are count once
            if other:
                again = self.letters(pa.array([x for x, _ in other], pa.string()))
                parts.append((again, np.array([row for _, row in other], np.int64)[again.doc]))
        return Found(parts, plain.count)


class Found:
    """Features of a slice of texts: ``row`` of the text, ``at`` (which word), ``word`` (hash of the word or of its first
    bytes), ``before`` and ``after`` (hashes of the feature and its word's neighbour), and ``count`` words a text."""

    def __init__(self, parts: list[tuple[Words, np.ndarray]], count: np.ndarray):
        row, at, word, before, after, base = [], [], [], [], [], 0
        for words, rows in parts:
            left, right = _neighbours(words)
            for pick, h in [(np.arange(len(words.hash)), words.hash), *(words.prefixes(k) for k in BEGINNINGS)]:
                row.append(rows[pick])
                at.append(pick + base)
                word.append(h)
                before.append(h * np.uint64(3) + left[pick])
                after.append(h * np.uint64(5) + right[pick])
            base += len(words.hash)
        self.row, self.at, self.word, self.before, self.after = map(np.concatenate, (row, at, word, before, after))
        self.count, self.words = count, base

    def signals(self, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each text: its most telling word, the sum over its words (each by its most telling feature), that sum a
        word, and its length."""
        n = len(self.count)
        best, total = np.zeros(n), np.zeros(n)
        if len(lexicon) and len(self.word):
            i = np.minimum(np.searchsorted(lexicon, self.word), len(lexicon) - 1)
            hit = np.flatnonzero(lexicon[i] == self.word)
            each, text = np.zeros(self.words), np.zeros(self.words, np.int64)
            np.maximum.at(each, self.at[hit], weights[i[hit]])
            text[self.at[hit]] = self.row[hit]
            told = np.flatnonzero(each)
            np.maximum.at(best, text[told], each[told])
            np.add.at(total, text[told], each[told])
        return np.stack([np.ones(n), best, np.log1p(total), np.minimum(1.0, total / np.maximum(1, self.count)), np.log1p(self.count)], axis=1)


def _as_strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def _neighbours(words: Words) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.roll(words.hash, 1), np.roll(words.hash, -1)
    if len(before):
        first = np.append(True, words.doc[1:] != words.doc[:-1])
        before[first] = 7
        after[np.append(first[1:], True)] = 7
    return before, after


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def word_evidence(train: DataFrame, lm: np.ndarray) -> DataFrame:
    """(word, bad, good): labelled documents with the word, by label; ``train``: (key, text, toxic)."""

    def run(batches):
        reader = Reader(lm)
        for batch in batches:
            for part in chunks(batch, limit=SLICE_BYTES):
                toxic = part.column(2).to_numpy(zero_copy_only=False) == 1
                found = reader.read(part.column(1))
                row, word = found.row, found.word
                pair = np.unique(np.stack([row.astype(np.uint64), word]), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
                hashes, at = np.unique(pair[1], return_inverse=True)
                bad = np.bincount(at, weights=toxic[pair[0].astype(np.int64)], minlength=len(hashes)).astype(np.int64)
                n = np.bincount(at, minlength=len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(hashes)), pa.array(bad), pa.array(n - bad)], ["word", "bad", "good"])
        del reader
        release_memory()

    rows = train.select("key", "text", "toxic").mapInArrow(run, "word long, bad long, good long")
    return rows.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def independent_evidence(train: DataFrame, lm: np.ndarray, lexicon: np.ndarray) -> DataFrame:
    """(word, bad, good) of the lexicon's words, counting documents that are the first, by a hash of their text, with both
    the word and its neighbour before, and the word and its neighbour after. ``train``: (key, text, toxic)."""

    def run(batches):
        reader = Reader(lm)
        for batch in batches:
            for part in chunks(batch, limit=SLICE_BYTES):
                keys, toxic = part.column(0).to_numpy(), part.column(2).to_numpy()
                found = reader.read(part.column(1))
                hit = np.flatnonzero(lexicon[np.minimum(np.searchsorted(lexicon, found.word), len(lexicon) - 1)] == found.word)
                row = found.row[hit]
                told = [pa.array(_signed(x[hit])) for x in (found.word, found.before, found.after)]
                told += [pa.array(keys[row]), pa.array(toxic[row].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(told, ["word", "before", "after", "key", "toxic"])

    rows = train.select("key", "text", "toxic").mapInArrow(run, "word long, before long, after long, key long, toxic long")
    rows = work_table(rows.distinct(), "pairs")
    # The least key of each word and neighbour, combined before it is shuffled: a neighbour may be very common.
    first = rows
    for side in ("before", "after"):
        first = first.join(rows.groupBy("word", side).agg(F.min("key").alias("key")), ["word", side, "key"], "left_semi")
    once = first.groupBy("word", "key").agg(F.max("toxic").alias("toxic"))
    return once.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def _surprise(bad, n, share: float):
    """n times the divergence of bad / n from the share of toxic documents, 0 where it is below."""
    p = F.col(bad) / F.col(n)
    q = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    return F.when(p > share, F.col(n) * (p * F.log(p / share) + q)).otherwise(0.0)


class Model:
    """A language model, sorted feature hashes with their weights, and the weights of a text's signals."""

    def __init__(self, lm: np.ndarray, words: np.ndarray, weights: np.ndarray, signals: np.ndarray):
        self.lm, self.words, self.weights, self.signals = lm, words, weights, signals

    def scores(self, reader: Reader, texts: pa.Array) -> np.ndarray:
        total = reader.read(texts).signals(self.words, self.weights) @ self.signals
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the first column is constant and not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (y - p) - shrink * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def is_held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that aren't held out. ``docs``: (doc_id, text); ``labels``: doc_id, toxic."""
    lm = language_model(character_counts(docs))
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sums = told.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    n, bad = int(sums["n"]), int(sums["bad"])
    share = (bad + 0.5) / (n + 1)
    base = np.array([math.log(share / (1 - share)), 0, 0, 0, 0])
    none = Model(lm, np.zeros(0, np.uint64), np.zeros(0), base)
    if not bad or bad == n:
        return none
    part = min(1.0, TRAIN_ROWS / n)
    picked = told.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))  # about TRAIN_ROWS rows at most
    rows = docs.join(F.broadcast(picked), "doc_id").select(F.xxhash64("text").alias("key"), "text", "toxic")
    rows = work_table(rows, "sample")  # about TRAIN_ROWS texts, read three times
    counts = work_table(word_evidence(rows, lm), "words").withColumn("n", F.col("bad") + F.col("good")).withColumn("surprise", _surprise("bad", "n", share))
    least = math.log(1 + counts.count()) + 2  # so many words are tried that one may look telling by chance
    best = counts.where((F.col("bad") >= 3) & (F.col("surprise") > least)).select("word")
    # Words of the sample whose evidence beats chance, one number each: the sample bounds them.
    lexicon = np.sort(best.toPandas()["word"].to_numpy(np.int64).view(np.uint64))
    if not len(lexicon):
        return none
    found = independent_evidence(rows, lm, lexicon).withColumn("n", F.col("bad") + F.col("good")).withColumn("surprise", _surprise("bad", "n", share)).collect()
    found = [r for r in found if r["bad"] >= 3 and r["surprise"] > least]
    bad_n, good_n = max(1.0, part * bad), max(1.0, part * (n - bad))
    weight = {np.int64(r["word"]).view(np.uint64): math.log((r["bad"] + 0.5) / (bad_n + 1)) - math.log((r["good"] + 0.5) / (good_n + 1)) for r in found}
    words = np.array(sorted(weight), np.uint64)
    weights = np.array([weight[w] for w in words])

    def signals(batches):
        reader = Reader(lm)
        for batch in batches:
            for part in chunks(batch, limit=SLICE_BYTES):
                x = reader.read(part.column(1)).signals(words, weights)
                yield pa.RecordBatch.from_arrays([part.column(2), *map(pa.array, x.T)], ["toxic", *"abcde"])

    seen = rows.mapInArrow(signals, "toxic int, a double, b double, c double, d double, e double").toPandas()  # about TRAIN_ROWS rows
    seen = seen.sort_values(["toxic", *"abcde"])  # the same sums in each run
    return Model(lm, words, weights, fit(seen[list("abcde")].to_numpy(float), seen["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text): the chance that a text with these words is toxic."""

    def run(batches):
        reader = Reader(model.lm)
        for batch in batches:
            for part in chunks(batch, limit=SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(reader, part.column(1)))], ["doc_id", "score"])
        del reader
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts get the score of a text without telling words. Without usable labels (none,
    or all alike) every text gets that score. Held out are rows whose crc32 of the id as text is a
    multiple of 5 (null ids are not). Rows are scored one by one, repeated ones too. Labels that contradict
    each other for one id count as toxic. An empty table gives an empty result; other columns are ignored.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    told = labels.select(labels[id_col].cast("long").alias("doc_id"), labels["toxic"].alias("toxic"))
    scored = score(docs, train(docs, told))
    held = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The input's rows that score below ``most``, with the input's columns; texts do not move. Null and blank texts have no evidence,
    equal texts share a score, rows that repeat an id are scored each by its own text, and an empty table stays empty."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    told = labels.select(labels[id_col].cast("long").alias("doc_id"), labels["toxic"].alias("toxic"))
    model = train(docs, told)

    def scores(texts: pd.Series) -> pd.Series:
        reader, batch = Reader(model.lm), pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        parts = [model.scores(reader, part.column(0)) for part in chunks(batch, limit=SLICE_BYTES)]
        return pd.Series(np.concatenate(parts) if parts else [])

    return df.where(F.pandas_udf(scores, "double")(text_of(df, text_col)) < most)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, learned from labels of rows that are not held out. Nulls, ties, empty tables: see score_toxicity."""
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
