"""Words and word windows of Arrow string batches as numpy arrays, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CHECK_BASE = 0xD1B54A32D192ED03
_powers: dict[int, np.ndarray] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, remembered."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 19), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= CHUNK_BYTES + 1:
            _powers[base] = have
    return have[:n]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, until - at)
        at = until


class Words:
    """The words of a slice of texts (no nulls): ``start``, ``end`` (bytes), ``doc`` (row), ``hash``."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2] if n else None
        self.data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
        self.bounds = bounds - bounds[0]
        size = len(self.data)
        inside = ~_SPACE[self.data]
        before, after = np.zeros(size, bool), np.zeros(size, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = self.bounds[:-1][self.bounds[:-1] < size]
        before[edge] = False
        after[edge[edge > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.bounds, self.start, "right") - 1
        self._sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power(_BASE, size), out=self._sums[1:])
        self.hash = self._hash(self.start, self.end)
        self.count = np.bincount(self.doc, minlength=n)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes from start to end, wherever they are."""
        return mix64((self._sums[end] - self._sums[start]) * _power(_BASE_INVERSE, max(1, len(self.data)))[start] + (end - start).astype(np.uint64))

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the first ``size`` bytes of all longer words; told apart from whole words."""
        longer = np.flatnonzero(self.end - self.start > size)
        return longer, ~self._hash(self.start[longer], self.start[longer] + size)

    def window_starts(self, width: int) -> np.ndarray:
        """The first word of every window of ``width`` words inside one text."""
        n = len(self.hash) - width + 1
        return np.flatnonzero(self.doc[:n] == self.doc[width - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def _window_hash(self, first: np.ndarray, width: int, base: int) -> np.ndarray:
        n = max(0, len(self.hash) - width + 1)
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total = total * np.uint64(base) + self.hash[j : j + n]
        return mix64(total[first])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of all windows of ``width`` words inside one text."""
        first = self.window_starts(width)
        return first, self._window_hash(first, width, _BASE_INVERSE)

    def window_checks(self, first: np.ndarray, width: int) -> np.ndarray:
        """A second, independent hash of those windows."""
        return self._window_hash(first, width, _CHECK_BASE)
