"""Cost-balanced packing of token sequences.

Documents are tokenized inside Spark tasks, an Arrow batch at a time: words are dictionary-encoded, only
the distinct ones are tokenized, and a text's ids are gathered by their words' places. A document's ids
are cut into full sequences and a rest. A task packs the rests of about ``GROUP_DOCS`` documents at a time:
by descending cost (linear plus quadratic attention cost) each goes to the sequence with the lowest
cost so far that has room, and is cut where the room ends. A group's sequences are as many as its tokens
need, so all but the last are full; the last is laid out as sequences of powers of two, which need no
padding. Nothing is shuffled: the numbers of a task's sequences begin with its partition's number.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, release_memory, text_of
from .textwords import chunks

SEQUENCE = 2048
END_ID = 1
GROUP_DOCS = 1024
#: Cost of n tokens: LINEAR * n + QUADRATIC * n^2; the ratio is that of a layer with width 1024
#: (12 d^2 n against 2 d n^2).
LINEAR, QUADRATIC = 12 * 1024**2, 2 * 1024
#: A slice of texts takes about 50 times as many bytes while its words are merged and gathered.
SLICE_BYTES = 1 << 19
#: Longer words go through the whole tokenizer: merging takes a step a symbol.
MERGED_BYTES = 64
SPLIT = "<|endoftext|>"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cost(n: int) -> int:
    return LINEAR * n + QUADRATIC * n * n


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each entry, one after the other."""
    ends = np.cumsum(size)
    at = np.repeat((start - (ends - size)).astype(np.int32), size)  # slices are far below 2^31 values
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


def _classes() -> np.ndarray:
    """Of each byte of a word: letter (0), digit (1), other mark (2), or none that may be cut simply (3)."""
    out = np.full(256, 3, np.int8)
    out[33:127] = 2
    out[48:58] = 1
    out[65:91] = out[97:123] = 0
    out[ord("'")] = 3  # may begin a short form
    return out


_CLASS = _classes()
_NONE = np.iinfo(np.int32).max


class Merges:
    """The vocabulary's merges, applied to many words at once: in each step every word merges its first pair of the
    lowest rank, until no word has a pair left."""

    def __init__(self, vocab: str):
        with open(vocab, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, end, letters = model["vocab"], model["end_of_word_suffix"], _byte_letters()
        self.inner = np.array([ids[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[letters[b] + end] for b in range(256)], np.int64)
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]]
        left, right, self.merged = np.array(pairs, np.int64).T
        self.width = len(ids) + 1024
        keys = left * self.width + right
        self.rank = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank]
        self.seen = np.zeros(1 << 22, bool)  # most pairs are no merge
        self.seen[self._slot(keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, out = left * self.width + right, np.full(len(left), _NONE, np.int32)
        may = np.flatnonzero(self.seen[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[may]), len(self.keys) - 1)
        hit = self.keys[at] == keys[may]
        out[may[hit]] = self.rank[at[hit]]
        return out

    def __call__(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of the words whose symbols follow each other in runs of ``size``; none is empty."""
        n = len(size)
        out_start, out_size, done, filled = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        name = np.arange(n)
        of = np.repeat(name, size)
        rank = np.full(len(symbols), _NONE, np.int32)
        inner = np.flatnonzero(of[:-1] == of[1:])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(name):
            best = np.minimum.reduceat(rank, np.cumsum(size) - size)
            ready = best == _NONE
            if ready.any():
                rows = np.repeat(ready, size)
                done.append(symbols[rows])
                out_size[name[ready]] = size[ready]
                out_start[name[ready]] = filled + np.cumsum(size[ready]) - size[ready]
                filled += len(done[-1])
                symbols, rank, name, size, best = symbols[~rows], rank[~rows], name[~ready], size[~ready], best[~ready]
            word = np.repeat(np.arange(len(name)), size)
            lowest = np.flatnonzero(rank == best[word])
            first = lowest[np.diff(word[lowest], prepend=-1) > 0]  # one in each word
            symbols[first] = self.merged[best]
            keep = np.ones(len(symbols), bool)
            keep[first + 1] = False
            symbols, rank, word = symbols[keep], rank[keep], word[keep]
            first -= np.arange(len(first))
            size = size - 1
            rank[first] = _NONE
            for at in (first[first + 1 < len(word)], first[first > 0] - 1):
                at = at[word[at] == word[at + 1]]
                rank[at] = self.ranks(symbols[at], symbols[at + 1])
        return np.concatenate(done) if done else symbols, out_start, out_size


#: A vocabulary's merges as arrays, some MB, read once by each Python worker.
_merges: dict[str, Merges] = {}


class Encoder:
    """Texts to ids, exactly as the tokenizer gives them.

    The vocabulary drops white space and splits there, so the distinct words of a slice of texts are encoded, and
    a text's ids gathered by its words. Words of Latin-1 letters, digits and ASCII marks are cut into runs of
    letters, single digits and runs of marks, and need no more than lower case and the byte alphabet
    before their merges; other words go through the whole tokenizer together, with a special token
    between them. Texts with a special token's string are encoded whole.
    """

    def __init__(self, vocab: str):
        if vocab not in _merges:
            _merges[vocab] = Merges(vocab)
            release_memory()  # the parsed file is many times as large
        self.vocab, self.merges = vocab, _merges[vocab]

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, for texts that need it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocab)

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, size) of words by the tokenizer itself."""
        ids, sizes, split_id = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], self.tokenizer.token_to_id(SPLIT)
        for at in range(0, len(words), 2048):
            joined = SPLIT.join(words[at : at + 2048])
            found = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(found == split_id)
            sizes.append(np.diff(np.concatenate(([-1], cuts, [len(found)]))) - 1)
            ids.append(found[found != split_id])
        return np.concatenate(ids), np.concatenate(sizes)

    def _simple(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words are simple, ids, size) of words at ``bounds`` in ``data``; size is 0 for the others."""
        low, kind = data.copy(), _CLASS[data]
        upper = (data >= 65) & (data <= 90)
        low[upper] += 32
        lead = np.flatnonzero(data[:-1] == 0xC3)  # the letters of Latin-1's upper half
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 0
        low[lead + 1] |= (data[lead + 1] < 0x9F).astype(np.uint8) << 5
        size = np.diff(bounds)
        bad = np.concatenate(([0], np.cumsum(kind == 3)))
        simple = (bad[bounds[1:]] == bad[bounds[:-1]]) & (size <= MERGED_BYTES)
        count = np.zeros(len(size), np.int64)
        rows = np.repeat(simple, size)
        of, low, kind = np.repeat(np.arange(len(size)), size)[rows], low[rows], kind[rows]
        if not len(of):
            return simple, np.zeros(0, np.int64), count
        begins = np.ones(len(of), bool)
        begins[1:] = (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        at = np.flatnonzero(begins)
        last = np.append(at[1:], len(of)) - 1
        symbols = self.merges.inner[low]
        symbols[last] = self.merges.last[low[last]]
        ids, start, held = self.merges(symbols, last - at + 1)
        np.add.at(count, of[at], held)
        return simple, gather(ids, start, held), count

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of distinct words."""
        words = words.cast(pa.large_string())
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        simple, ids, size = self._simple(data, bounds - bounds[0])
        start = np.cumsum(size) - size
        if not simple.all():
            rest = np.flatnonzero(~simple)
            more, size[rest] = self._whole(words.take(pa.array(rest)).to_pylist())
            start[rest] = len(ids) + np.cumsum(size[rest]) - size[rest]
            ids = np.concatenate((ids, more))
        return ids, start, size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each text's ids); END_ID closes each text. No nulls."""
        is_special = pc.match_substring(texts, "<|")
        special = np.flatnonzero(is_special.to_numpy(zero_copy_only=False))
        split = pc.ascii_split_whitespace(pc.if_else(is_special, "", texts) if len(special) else texts)
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        ids, start, size = self._words(coded.dictionary)
        # More entries: the end, and each text with a special token's string.
        more = [[END_ID], *(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids for i in special)]
        closing, held = len(size), np.array(list(map(len, more)), np.int64)
        start = np.concatenate((start, len(ids) + np.cumsum(held) - held))
        ids, size = np.concatenate((ids, *(np.array(x, np.int64) for x in more))), np.concatenate((size, held))
        word = np.insert(
            coded.indices.to_numpy().astype(np.int64), np.concatenate((ends[special], ends)),
            np.concatenate((closing + 1 + np.arange(len(special)), np.full(len(ends), closing, np.int64))),
        )
        before = np.zeros(len(ends), np.int64)
        before[special] = 1
        entry_ends = ends + np.arange(1, len(ends) + 1) + np.cumsum(before)
        sizes = size[word]
        return gather(ids.astype(np.uint32), start[word], sizes), np.cumsum(sizes)[entry_ends - 1]


def place(lengths: list[int], length: int) -> list[list[tuple[int, int, int, int, int]]]:
    """For each rest, its pieces (start in it, length, sequence, offset, capacity); sequences count from 0."""
    total = sum(lengths)
    room = [length] * (total // length)
    left = total % length
    room += [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]  # powers of two need no padding
    capacity, used = list(room), [0] * len(room)
    heap = [(0, -c, s) for s, c in enumerate(room)]
    heapq.heapify(heap)
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in lengths]
    for i in sorted(range(len(lengths)), key=lambda i: (-cost(lengths[i]), i)):
        start = 0
        while start < lengths[i]:
            spent, _, s = heapq.heappop(heap)
            n = min(lengths[i] - start, room[s])
            out[i].append((start, n, s, used[s], capacity[s]))
            room[s] -= n
            used[s] += n
            start += n
            if room[s]:
                heapq.heappush(heap, (spent + cost(n), -room[s], s))
    return out


#: Bits of a sequence's number for its place in a partition, and for the partition; above them stands the call, modulo CALLS.
SEQUENCE_BITS, PARTITION_BITS, CALLS = 30, 22, 1 << 11
_calls = itertools.count()
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, capacity long"
NAMES = [c.split()[0] for c in PIECES.split(", ")]


def _pieces(doc: pa.Array, ids: np.ndarray, at: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row a piece: ``at`` is its first place in ``ids``; columns: start, length, doc_tokens, sequence_id, offset, capacity."""
    start, size, tokens, sequence, offset, capacity = columns
    edges = np.concatenate(([0], 4 * np.cumsum(size))).astype(np.int32)
    raw = pa.py_buffer(gather(ids, at, size).astype("<u4").tobytes())
    binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges.tobytes()), raw])
    rest = [pa.array(x.astype(np.int64)) for x in (tokens, sequence, offset, capacity)]
    first = [pa.array(x.astype(np.int64)) for x in (start, size)]
    return pa.RecordBatch.from_arrays([doc, *first, binary, *rest], NAMES)


class _Group:
    """Rests that wait for each other: document, its tokens, where the rest starts in it, ids."""

    def __init__(self):
        self.docs, self.tokens, self.starts, self.ids, self.sizes = [], [], [], [], []

    def __len__(self) -> int:
        return len(self.sizes)

    def add(self, doc: list, tokens: np.ndarray, start: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.docs += doc
        self.tokens += tokens.tolist()
        self.starts += start.tolist()
        self.sizes += size.tolist()
        self.ids.append(ids)

    def packed(self, first: int, length: int) -> tuple[pa.RecordBatch, int]:
        """The rests' pieces, in sequences from number ``first`` on, and the number after the last."""
        ids, ends = np.concatenate(self.ids), np.cumsum(self.sizes)
        rows = [
            (i, ends[i] - self.sizes[i] + a, self.starts[i] + a, n, self.tokens[i], first + s, at, c)
            for i, pieces in enumerate(place(self.sizes, length)) for a, n, s, at, c in pieces
        ]
        owner, at, *columns = np.array(rows, np.int64).T
        doc = pa.array(self.docs, pa.int64()).take(pa.array(owner))
        return _pieces(doc, ids, at, columns), int(columns[3].max()) + 1


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, length: int = SEQUENCE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, capacity.

    Each document is its ids and then id 1, so null and blank texts are one token. Each id lies in
    one piece. ``capacity`` is the length of the piece's sequence: ``length`` or a power of two, and
    all sequences are full. Repeated rows and rows without an id are documents of their own (a
    null id stays null). An empty table gives an empty result; other columns are ignored. Which documents
    meet in a sequence depends on how the input is partitioned; no partition size is needed for right results. A sequence's
    number is made of the call's in this session, the input partition's and the place in it, so results can be coalesced and put
    together with others.
    """
    vocab = vocab or vocabulary()
    # The partition's own number, which stays when a later coalesce or union puts partitions into one task.
    number = F.spark_partition_id().cast("long") + F.lit((next(_calls) % CALLS) << PARTITION_BITS)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text_of(df, text_col).alias("text"), number.alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, group, next_id = Encoder(vocab), _Group(), None
        for batch in batches:
            if next_id is None and batch.num_rows:
                next_id = batch.column(2)[0].as_py() << SEQUENCE_BITS
            for part in chunks(batch, limit=SLICE_BYTES):
                ids, ends = encode(part.column(1))
                size = np.diff(ends, prepend=0)
                full = size // length
                if full.any():
                    owner = np.repeat(np.arange(len(size)), full)
                    nth = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
                    at, all_full = (ends - size)[owner] + nth * length, np.full(len(owner), length)
                    numbers = next_id + np.arange(len(owner))
                    columns = [nth * length, all_full, size[owner], numbers, np.zeros(len(owner)), all_full]
                    next_id += len(owner)
                    yield _pieces(part.column(0).take(pa.array(owner)), ids, at, columns)
                rest = np.flatnonzero(size % length)
                doc = part.column(0).take(pa.array(rest)).to_pylist()
                left = size[rest] % length
                group.add(doc, size[rest], (full * length)[rest], gather(ids, ends[rest] - left, left), left)
                if len(group) >= group_docs:
                    batch_out, next_id = group.packed(next_id, length)
                    group = _Group()
                    yield batch_out
        if len(group):
            yield group.packed(next_id, length)[0]
        del encode, group
        release_memory()

    return docs.mapInArrow(run, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``. Nulls, repeated rows, empty tables: see pack."""
    packed = pack(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "capacity")
