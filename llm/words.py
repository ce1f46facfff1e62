"""Words of Arrow text columns as numpy arrays: boundaries, 64-bit hashes and hashes of runs of words.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D; UTF-8 keeps these bytes for white space alone,
so words of bytes are words of code points. Hashes depend on the bytes only, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For terms: every ASCII byte that is neither letter nor digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves every output bit."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (seed + 1)) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(256, dtype=np.uint64), 17) | np.uint64(1)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose text is at most ``most`` bytes together; a longer text comes alone."""
    if not batch.num_rows:
        return
    _, ends = buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row boundaries in them. A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


class Words:
    """start and end (bytes), row and hash of every word of a text column, in order."""

    def __init__(self, column, lower: bool = False, between: np.ndarray = SPACE):
        data, self.bounds = buffers(column)
        self.rows = len(self.bounds) - 1
        self.data = LOWER[data] if lower else data
        self.between = between
        out = ~between[self.data]
        edge = np.zeros(len(out) + 1, bool)
        edge[self.bounds] = True
        starts, stops = out.copy(), out.copy()
        if len(out):
            starts[1:] &= ~out[:-1] | edge[1:-1]
            stops[:-1] &= ~out[1:] | edge[1:-1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, self.bounds)  # of each row, in the words
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        n = 1 << max(16, int(len(self.data)).bit_length())
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _powers(n, _BASE)[:len(self.data)], out=sums[1:])
        back = _powers(n, pow(_BASE, -1, 2**64))[self.start]
        return mix((sums[self.end] - sums[self.start]) * back + (self.end - self.start).astype(np.uint64))

    def distinct(self) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word in the list of distinct words, and that list."""
        if not len(self):
            return np.zeros(0, np.int64), []
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)])
        kind, width = (pa.binary(), np.int32) if ends[-1] < 2**31 else (pa.large_binary(), np.int64)
        letters = self.data[~self.between[self.data]]
        found = pa.Array.from_buffers(kind, len(self), [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(letters)]).dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()

    def runs(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of n words within one row start, and their hashes."""
        if len(self) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:len(self) - n + 1] == self.row[n - 1:])
        return at, mix(combine(hashes, n)[at], n)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """A polynomial over each n neighbours, built from runs of doubling length."""
    if n == 1:
        return hashes
    half = n // 2
    left = combine(hashes, half)
    both = left[:-half] + left[half:] * np.uint64(pow(_STEP, half, 2**64))
    if n % 2:
        both = both[:-1] + hashes[n - 1:] * np.uint64(pow(_STEP, n - 1, 2**64))
    return both


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
