"""Vectorised text kernels: Arrow string columns to word spans and 64-bit hashes.

Everything here works on the raw UTF-8 buffers of one Arrow batch, in chunks of
bounded size, so a Python object per word is never made.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call handles; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
#: An odd multiplier and its inverse mod 2**64, and a random value for each byte.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A multiplier for each place of a word in an n-gram.
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is True for bytes inside one of the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Lower-casing of A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_pow = np.ones(0, dtype=np.uint64)
_inv = np.ones(0, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        if n > 8 * CHUNK_BYTES:  # one very long text: not kept
            return _powers(n, _BASE), _powers(n, _BASE_INV)
        size = max(n, CHUNK_BYTES)
        _pow, _inv = _powers(size, _BASE), _powers(size, _BASE_INV)
    return _pow[:n], _inv[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; a null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, raw


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column with at most `limit` bytes (or one row): (first, last, offsets, bytes)."""
    if not len(column):
        return
    offsets, raw = buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        a, b = int(offsets[first]), int(offsets[last])
        yield first, last, offsets[first : last + 1] - a, raw[a:b]
        first = last


class Words:
    """The words of some consecutive texts.

    `start` and `end` are byte offsets into `raw`; `doc` is the row of each word;
    `row` holds, for each text, the index of its first word (one more than texts).
    """

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, word_bytes: np.ndarray, fold: np.ndarray | None = None):
        self.raw = raw = fold[raw] if fold is not None else raw
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = word_bytes[raw]
        # a word never reaches over the border of two texts
        begin = inside[1:-1] & ~inside[:-2]
        stop = inside[1:-1] & ~inside[2:]
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(raw))]
        begin[borders] = inside[1:-1][borders]
        stop[borders - 1] = inside[1:-1][borders - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.row = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.row))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.raw)
        if not n:
            return np.zeros(0, np.uint64)
        powers, inverse = _tables(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.raw] * powers, out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on (len - n + 1 of them, borders of texts ignored)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out += words[k : k + m] * PLACE[k]
    return mix(out)


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """As ngrams, in time that does not depend on n: differences of one running polynomial."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    powers, inverse = _tables(len(words))
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers, out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[:m])


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which a worker gives freed memory back: workers stay for later stages, beside other processes."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return tidied
