"""Words of whole Arrow string columns as numpy arrays: positions and 64-bit hashes without a Python object per word.

A word is a run of bytes outside 0x20 and 0x09-0x0D, as in the pattern [^\\x20\\x09-\\x0D]+.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []
caches: dict[str, Callable[[], None]] = {}  # of what a worker keeps from task to task: name -> what empties it


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        factors = [np.full(size, b, np.uint64) for b in (_BASE, _UNBASE)]
        for f in factors:
            f[0] = 1
        _powers[:] = [np.cumprod(f) for f in factors]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def portions(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 21, cache: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about `most` bytes of text each (one row at least), so that memory stays bounded. Caches that earlier stages left in this worker are emptied, but for the one named."""
    for name, emptied in caches.items():
        if name != cache:
            emptied()
    for batch in batches:
        _, offsets = strings(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


class Words:
    """Words of some rows: start, end (bytes in data), row, hash; row r has words first[r] to first[r + 1]. space: whether each byte (lower-cased, if lower) stands between words."""

    def __init__(self, column: pa.Array, lower: bool = False, space: np.ndarray = _SPACE):
        data, offsets = strings(column)
        self.rows = len(offsets) - 1
        if lower:
            data = _LOWER[data]
        inside = ~space[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = inside.copy()
        before[1:] &= ~inside[:-1] | cut[1:-1]
        after = inside.copy()
        after[:-1] &= ~inside[1:] | cut[1:-1]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(before), np.flatnonzero(after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            n = len(self.data)
            up, down = _power_tables(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUES[self.data] * up[:n], out=sums[1:])
            self._hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        return self._hash


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries; the caller leaves out those that cross rows."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + n])
    return out


def within(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the k-word shingles that lie within one row, and their rows; rows have words first[r] to first[r + 1]."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    skipped = np.cumsum(count) - count
    return np.arange(len(row)) - skipped[row] + first[row], row
