"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases that a Lempel-Ziv dictionary learns from it; the set of phrase hashes
is sketched by its minimum in each of ``BINS`` bins. The share of bins that agree estimates the
overlap of two dictionaries, which is a likeness in the sense of compression.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shuffle_partitions, text_of
from .textwords import mix64

BINS = 128
EMPTY = 0xFFFF
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def parse(text: str, known: set[str], order: list[str], phrase: str = "") -> str:
    """Parse on: append the text's phrases to ``order`` and ``known``, return the open one at its end. A
    phrase is the shortest run of characters that isn't known yet; phrases follow each other in the text."""
    add, append = known.add, order.append
    for c in text:
        phrase += c
        if phrase not in known:
            add(phrase)
            append(phrase)
            phrase = ""
    return phrase


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def sketch(text: str, order: list[str], phrase: str) -> np.ndarray:
    """The least phrase hash in each bin, 16 bits of it; EMPTY where the bin has none. The open phrase counts too."""
    global _up, _down
    out = np.full(BINS, EMPTY, np.uint16)
    ends = np.cumsum(np.fromiter(map(len, [*order, phrase] if phrase else order), np.int64))
    if not len(ends):
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) > len(_up):
        _up, _down = _powers(_BASE, 2 * len(codes)), _powers(_INVERSE, 2 * len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix64(codes + np.uint64(1)) * _up[: len(codes)], out=sums[1:])
    starts = np.concatenate(([0], ends[:-1]))
    h = mix64((sums[ends] - sums[starts]) * _down[starts])
    h.sort()
    bins = (h >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = np.minimum(mix64(h[first]) >> np.uint64(48), np.uint64(EMPTY - 1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bins that agree among those that either side fills; 1 for two empty sketches."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = int(filled.sum())
    return float((filled & (a == b)).sum() / n) if n else 1.0


def as_hex(sketched: np.ndarray) -> str:
    return sketched.astype(">u2").tobytes().hex()


def fingerprint(text: str) -> np.ndarray:
    order: list[str] = []
    return sketch(text, order, parse(text, set(), order))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row: 4 hexadecimal digits a bin. A null text is an empty one, whose bins are all empty; repeated
    rows come as often, equal texts have equal fingerprints, an empty table gives no rows. Other columns are ignored."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: as_hex(fingerprint(t)))

    return docs.select("doc_id", F.pandas_udf(of, "string")("text").alias("fingerprint"))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see the columns in RESULT.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next
    document's (or all of them), by ascending id; the last document's next is the first. Ids may
    repeat: such rows follow each other by text. Null ids come last, null text is empty. A single row
    is its own next. An empty table gives an empty result; other columns are ignored.

    Texts move once, into ranges of ids; the first document of a range is also sent to the range before.
    """
    spark = df.sparkSession
    last_id = np.iinfo(np.int64).max
    docs = df.select(F.coalesce(df[id_col].cast("long"), F.lit(int(last_id))).alias("key"), df[id_col].cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    ranges = shuffle_partitions(spark) * 4
    found = docs.select("key").repartitionByRange(ranges, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("low")).select("low").collect()  # one number a range
    lows = np.sort(np.array([r["low"] for r in found], np.int64))

    def where(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy(np.int64)
        at = np.searchsorted(lows, k, "right") - 1
        return pd.Series([[2 * i] if lows[i] != x else [2 * i, 2 * ((i - 1) % len(lows)) + 1] for i, x in zip(at.tolist(), k, strict=True)])

    spread = docs.select("key", "doc_id", "text", F.explode(F.pandas_udf(where, "array<long>")("key")).alias("at"))
    spread = spread.select(F.shiftright("at", 1).alias("range"), (F.col("at") % 2).alias("tail"), "key", "doc_id", "text")

    def run(batches):
        held = None  # the document whose next one is still to come

        def read(text):
            """Its half, what was known there (phrases as set and list, the open phrase), and the whole text's sketch."""
            known: set[str] = set()
            order: list[str] = []
            half = len(text) - len(text) // 2
            phrase = parse(text[:half], known, order)
            at_half = (half, known.copy(), order.copy(), phrase)
            return at_half, sketch(text, order, parse(text[half:], known, order, phrase))

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if held and held[0] != r.range:
                    held = None
                if r.tail and held is None:
                    continue
                at_half, own = read(r.text)
                if held:
                    _, doc, text, (half, known, order, phrase), old = held
                    head = r.text[: len(text) // 2]
                    edited_text = text[:half] + head
                    edited = sketch(edited_text, order, parse(head, known, order, phrase))
                    digest = hashlib.sha256(edited_text.encode()).hexdigest()
                    out.append((doc, len(text), digest, as_hex(old), as_hex(edited), likeness(old, edited), likeness(old, own)))
                held = None if r.tail else (r.range, None if pd.isna(r.doc_id) else int(r.doc_id), r.text, at_half, own)
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    placed = spread.repartition(shuffle_partitions(spark), "range").sortWithinPartitions("range", "tail", "key", "text")
    return placed.mapInPandas(run, RESULT)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in order of ids. Nulls, repeated ids, empty tables: see compare_with_next."""
    return compare_with_next(read_table(spark, sf_dir, "documents"))
