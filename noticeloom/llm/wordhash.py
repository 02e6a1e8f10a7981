"""Vectorised word and shingle hashing of Arrow string batches.

A word is a run of bytes other than the ASCII white space ``\\x20 \\x09-\\x0D``; A-Z are lower-cased first.
Every text is processed whole.  All hashes are 64 bits: a word is a polynomial over random byte codes modulo
2**64, finished by a mixer, so hashing needs a few numpy passes over the bytes of a batch and no per-word Python.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits; words between these are bare of punctuation.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    codes = np.random.Generator(np.random.PCG64(20240901)).integers(1, 1 << 63, 256, dtype=np.uint64)
    return codes[_LOWER]  # lower-casing costs nothing here


_powers = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE**i`` and its inverse for i below n at least; tables grow to the longest slice seen."""
    if _powers["n"] < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Words of some rows: ``start``/``end`` byte positions, ``doc`` row of each word, ``ptr`` words before each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE):
        self.data, self.offsets, n = data, offsets - offsets[0], len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~breaks[data]
        begins = inside[1:-1] & ~inside[:-2]
        edges = self.offsets[1:-1]
        edges = edges[edges < n]
        begins[edges] = inside[1:-1][edges]  # rows touch in the buffer: a row's first byte begins a word
        self.start = np.flatnonzero(begins)
        ends = inside[1:-1] & ~inside[2:]
        before = edges[edges > 0] - 1
        ends[before] = inside[1:-1][before]
        self.end = np.flatnonzero(ends) + 1
        self.ptr = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        self._sums: np.ndarray | None = None

    def _prefix(self) -> np.ndarray:
        if self._sums is None:
            up, _ = _power_tables(len(self.data) + 1)
            sums = np.empty(len(self.data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_codes()[self.data] * up[: len(self.data)], out=sums[1:])
            self._sums = sums
        return self._sums

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each byte range; equal bytes (up to case) have equal hashes."""
        sums = self._prefix()
        _, down = _power_tables(len(self.data) + 1)
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingle hashes of each row, sorted within the row, and the n+1 row offsets.

    A row of fewer words has its whole word sequence as one shingle; a row without words has none.
    """
    h, n = words.hashes(), np.diff(words.ptr)
    if not len(h):
        return np.empty(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    whole = len(h) - width + 1
    parts, docs = [], []
    if whole > 0:
        acc = np.zeros(whole, np.uint64)
        for i in range(width):
            acc = mix(acc * np.uint64(3) + h[i : i + whole])
        same = words.doc[:whole] == words.doc[width - 1 :]
        parts.append(acc[same])
        docs.append(words.doc[:whole][same])
    for k in range(1, width):  # rows of k words
        short = np.flatnonzero(n == k)
        if len(short):
            acc = np.full(len(short), k * 0x51ED, np.uint64)
            for i in range(k):
                acc = mix(acc * np.uint64(5) + h[words.ptr[short] + i])
            parts.append(acc)
            docs.append(short)
    if not parts:
        return np.empty(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    value, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    value, doc = value[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(n) + 1))
    out, sizes = [], np.zeros(len(n) + 1, np.int64)
    for i in range(len(n)):
        distinct = np.unique(value[bounds[i] : bounds[i + 1]])
        out.append(distinct)
        sizes[i + 1] = len(distinct)
    return np.concatenate(out), np.cumsum(sizes)
