"""Substring dedup by prefix-partitioned suffix trees over words.

Every word starts a suffix. Counts of suffix prefixes, over all texts, cut the suffixes into groups of
bounded size: where a first word is rare the group is a run of first words, where it is frequent the
prefix grows to two words, and where that is still too frequent to all ``width`` words. A group is a
forest of subtrees that no other group touches; a task sorts the group's suffixes and finds the
internal nodes at depth ``width`` that documents share. Overlapping nodes join to maximal repeats
when they are laid back over their document.

A suffix travels as the identity of its node at depth ``width`` (80 bits of two independent hashes over
its words, besides the group's prefix) and its document. A task first joins what its own
slice of texts shares, so a passage that a third of all documents hold travels once a slice.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shuffle_partitions, text_of, work_table
from .textwords import Words, chunks, mix64

WIDTH = 13
GROUP_SUFFIXES = 1 << 19
FIRST_BITS, SECOND_BITS = 12, 4
NO_ID = np.iinfo(np.int64).max
_MASK = np.uint64((1 << 56) - 1)
CHECK_BYTES = 3
_CHECK_MASK = np.uint64((1 << 8 * CHECK_BYTES) - 1)


def _codes(words: Words, first: np.ndarray) -> np.ndarray:
    """The two-word prefix of each suffix as a number: its top bits are the first word's."""
    one = words.hash[first] >> np.uint64(64 - FIRST_BITS)
    two = words.hash[np.minimum(first + 1, len(words.hash) - 1)] >> np.uint64(64 - SECOND_BITS)
    return (one << np.uint64(SECOND_BITS) | two).astype(np.int64)


def prefix_counts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(code, n): suffixes of ``width`` words or more under each two-word prefix code, over all texts."""

    def run(batches):
        total = np.zeros(1 << FIRST_BITS + SECOND_BITS, np.int64)
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column(part.schema.get_field_index("text")))
                first = words.window_starts(width)
                total += np.bincount(_codes(words, first), minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def cut_prefixes(counts: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each prefix code its first group and its number of groups; and the number of all groups.

    Neighbouring short prefixes share a group up to ``group`` suffixes; a first word above that is cut
    by the second word, and a two-word prefix above that by the whole window into several groups.
    """
    base, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    now, filled, span = 0, 0, 1 << SECOND_BITS
    for one in range(0, len(counts), span):
        whole = int(counts[one : one + span].sum())
        for at, n, step in [(one, whole, span)] if whole <= group else [(one + i, int(counts[one + i]), 1) for i in range(span)]:
            if n > group:
                now, filled = now + (filled > 0), 0
                base[at], parts[at] = now, -(-n // group)
                now += int(parts[at])
            else:
                if filled + n > group:
                    now, filled = now + 1, 0
                base[at : at + step] = now
                filled += n
    return base, parts, now + 1


def _low_bytes(values: np.ndarray, size: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _from_low_bytes(raw: bytes, size: int) -> np.ndarray:
    cut = np.frombuffer(raw, np.uint8).reshape(-1, size)
    wide = np.zeros((len(cut), 8), np.uint8)
    wide[:, :size] = cut
    return wide.view("<u8")[:, 0]


def _pack(ids: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted document ids as deflated steps, 7 bytes a key and 3 a check."""
    steps = np.diff(ids, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zlib.compress(steps, 1), _low_bytes(keys, 7), _low_bytes(checks, CHECK_BYTES)


def _unpack(ids: bytes, keys: bytes, checks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = np.frombuffer(zlib.decompress(ids), np.uint8).reshape(8, -1).T.copy().view("<i8")[:, 0]
    return np.cumsum(steps), _from_low_bytes(keys, 7), _from_low_bytes(checks, CHECK_BYTES)


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _split(by: np.ndarray, *columns: np.ndarray):
    """(value, columns of its rows) for each value of ``by``; rows keep their order."""
    order = np.argsort(by, kind="stable")
    by = by[order]
    edges = np.flatnonzero(np.diff(by, prepend=by[:1] - 1))
    for lo, hi in zip(edges, [*edges[1:], len(by)], strict=True):
        yield int(by[lo]), [c[order[lo:hi]] for c in columns]


def _shared(ids: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a sorted set of suffixes: which are the first of a node, and which lie under a node
    that a document with a smaller id reaches too. Both as indexes."""
    order = np.lexsort((ids, keys))
    k, c, d = keys[order], checks[order], ids[order]
    same = k[1:] == k[:-1]
    if (same & (c[1:] != c[:-1])).any():  # one key, two windows
        order = np.lexsort((ids, checks, keys))
        k, c, d = keys[order], checks[order], ids[order]
        same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    new = np.ones(len(k), bool)
    new[1:] = ~same
    lead = np.flatnonzero(new)
    least = d[lead][np.cumsum(new) - 1]
    repeat = np.zeros(len(k), bool)
    repeat[1:] = ~new[1:] & (d[1:] == d[:-1])
    return order[lead], order[(d > least) & ~repeat]


NODES = "bucket long, ids binary, keys binary, checks binary"
SUFFIXES = f"grp long, kind int, {NODES}"


def suffixes(docs: DataFrame, base: np.ndarray, parts: np.ndarray, groups: int, buckets: int, width: int) -> DataFrame:
    """Rows of suffixes by group (kind 0), and repeats that a slice found by itself (kind 1) by bucket of documents."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                words = Words(part.column(1))
                first, keys = words.windows(width)
                if not len(first):
                    continue
                codes = _codes(words, first)
                grp = base[codes] + ((keys >> np.uint64(8)) % parts[codes].astype(np.uint64)).astype(np.int64)
                keys, checks, doc = keys & _MASK, words.window_checks(first, width) & _CHECK_MASK, ids[words.doc[first]]
                # The group tells suffixes apart as well as the key does.
                lead, repeat = _shared(doc, keys ^ (grp.astype(np.uint64) << np.uint64(56)), checks)
                lead = lead[np.argsort(doc[lead], kind="stable")]
                rows = [(g, 0, 0, *_pack(*held)) for g, held in _split(grp[lead], doc[lead], keys[lead], checks[lead])]
                repeat = repeat[np.argsort(doc[repeat], kind="stable")]
                if len(repeat):
                    found = _split(_bucket(doc[repeat], buckets), doc[repeat], keys[repeat], checks[repeat])
                    rows += [(b % groups, 1, b, *_pack(*held)) for b, held in found]
                grps, kinds, bucket, i, k, c = zip(*rows, strict=True)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                columns = [pa.array(v, t) for v, t in zip((grps, kinds, bucket, i, k, c), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "kind", "bucket", "ids", "keys", "checks"])

    return docs.select("doc_id", "text").mapInArrow(run, SUFFIXES)


def repeated_nodes(suffix_rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ids, keys, checks): for each bucket of documents, (document, node) where the node is deep, shared, and
    first reached by a document with a smaller id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(r.bucket, r.ids, r.keys, r.checks) for r in pdf[pdf["kind"] == 1].itertuples()]
        held = [_unpack(r.ids, r.keys, r.checks) for r in pdf[pdf["kind"] == 0].itertuples()]
        if held:
            ids, keys, checks = (np.concatenate(part) for part in zip(*held, strict=True))
            _, repeat = _shared(ids, keys, checks)
            repeat = repeat[np.argsort(ids[repeat], kind="stable")]
            if len(repeat):
                found = _split(_bucket(ids[repeat], buckets), ids[repeat], keys[repeat], checks[repeat])
                out += [(b, *_pack(*of_bucket)) for b, of_bucket in found]
        return pd.DataFrame(out, columns=["bucket", "ids", "keys", "checks"])

    return suffix_rows.groupBy("grp").applyInPandas(run, NODES)


def _marks(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One number for (document, node); the node's check is compared beside it."""
    return mix64(mix64(ids.view(np.uint64)) ^ keys)


def _sorted_marks(held: list) -> tuple[np.ndarray, np.ndarray]:
    """The marks of unpacked nodes in order, and their checks."""
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    marks = np.concatenate([_marks(i, k) for i, k, _ in held])
    checks = np.concatenate([c for *_, c in held])
    order = np.argsort(marks)
    return marks[order], checks[order]


def _is_marked(marks: np.ndarray, checks: np.ndarray, hits: np.ndarray, hit_checks: np.ndarray) -> np.ndarray:
    """Which (mark, check) are among the hits, of which several may have one mark."""
    found = np.zeros(len(marks), bool)
    at = np.searchsorted(hits, marks)
    open_ = np.flatnonzero(at < len(hits))
    open_ = open_[hits[at[open_]] == marks[open_]]
    while len(open_):
        same = hit_checks[at[open_]] == checks[open_]
        found[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < len(hits)]
        open_ = open_[hits[at[open_]] == marks[open_]]
    return found


def _strip(texts: pd.Series, ids: np.ndarray, hits: np.ndarray, hit_checks: np.ndarray, width: int):
    """For each text: words, removed spans, kept text. ``hits``: sorted (document, node) marks."""
    words = Words(pa.array(texts, pa.string()))
    first, keys = words.windows(width)
    checks = words.window_checks(first, width) & _CHECK_MASK
    hit = first[_is_marked(_marks(ids[words.doc[first]], keys & _MASK), checks, hits, hit_checks)]
    cover = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    gone = np.cumsum(cover)[:-1] > 0
    begins = np.concatenate(([0], np.cumsum(words.count)))
    data = words.data.tobytes()
    for i in range(len(texts)):
        lo, hi = begins[i], begins[i + 1]
        own = data[words.bounds[i] : words.bounds[i + 1]].split()
        drop = gone[lo:hi]
        if drop.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([False], drop, [False])).astype(np.int8)))
            spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
            own = [w for w, d in zip(own, drop.tolist(), strict=True) if not d]
        else:
            spans = []
        yield hi - lo, int(drop.sum()), spans, b" ".join(own).decode()


RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, removed (word spans: the maximal repeats), kept_text.

    A word goes if a window of ``width`` words that covers it also starts in a document with a smaller
    id; windows are those of the input. kept_text joins the other words by one blank. Null and blank
    texts have no words. A null id counts as larger than all others. Rows with one id do not
    remove each other's words. Texts under ``width`` words stay whole. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = df.sparkSession
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    counts = np.zeros(1 << FIRST_BITS + SECOND_BITS, np.int64)
    for r in prefix_counts(docs, width).collect():  # one number a prefix code, at most 2^16
        counts[r["code"]] = r["n"]
    base, parts, groups = cut_prefixes(counts, group_suffixes)
    buckets = max(shuffle_partitions(spark), groups) * 2
    nodes = repeated_nodes(suffixes(docs, base, parts, groups, buckets, width), buckets)
    nodes = work_table(nodes, "nodes")

    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(_bucket(ids.fillna(NO_ID).to_numpy(np.int64), buckets))

    docs = docs.withColumn("bucket", F.pandas_udf(bucket_of, "long")("doc_id"))

    def run(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        hits, hit_checks = _sorted_marks([_unpack(r.ids, r.keys, r.checks) for r in found.itertuples()])
        ids = texts["doc_id"].astype("Int64")
        plain = ids.fillna(NO_ID).to_numpy(np.int64)
        sizes = texts["text"].str.len().cumsum().to_numpy()
        out, at = [], 0
        while at < len(texts):  # slices of bounded size, for the word arrays
            until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 20), "right")))
            out += _strip(texts["text"].iloc[at:until], plain[at:until], hits, hit_checks, width)
            at = until
        frame = pd.DataFrame(out, columns=["n_words", "n_removed", "removed", "kept_text"])
        frame.insert(0, "doc_id", ids.to_numpy())
        return frame

    return docs.groupBy("bucket").cogroup(nodes.groupBy("bucket")).applyInPandas(run, RESULT)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``. Nulls, repeated ids, empty tables: see remove_repeats."""
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "removed")


OP8_SQL = None
