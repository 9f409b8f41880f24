"""UTF-8 texts of an Arrow batch as numpy bytes: words, lines, hashes.

The functions work on the bytes of many texts at once.  A 64-bit hash of a
word, or of k consecutive words, is a difference of prefix sums of a polynomial
modulo 2**64, mixed afterwards.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _BASE, np.uint64)
    up[0] = 1
    down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if lower:
        values[65:91] = values[97:123]
    return values


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES):
    """Slices of a batch with about ``most`` bytes of text each (a longer text stands alone)."""
    if not batch.num_rows:
        return
    _, at = buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts of a column.

    starts, ends: byte range of each word; doc: the row it is in; first: index of
    each row's first word (n + 1 entries).
    """

    def __init__(self, column: pa.Array):
        self.data, self.at = buffers(column)
        n = len(self.data)
        inside = ~_SPACE[self.data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        edges = self.at[1:-1]
        before[edges[edges < n]] = False
        after[edges[(edges > 0) & (edges <= n)] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(column)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word; lower: A-Z count as a-z."""
        return range_hashes(_byte_values(lower)[self.data], self.starts, self.ends)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they are in one row."""
        n = len(hashes)
        whole = np.zeros(n, bool)
        if n >= k:
            whole[:n - k + 1] = self.doc[:n - k + 1] == self.doc[k - 1:]
        lo = np.arange(n)
        return range_hashes(hashes, lo, np.minimum(lo + k, n)), whole


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def joined_words(words: Words, keep: np.ndarray | None = None) -> list[bytes]:
    """Each row's words (those to keep) joined by one space."""
    keep = np.ones(len(words.starts), bool) if keep is None else keep
    starts, ends = words.starts[keep], words.ends[keep]
    rows = words.doc[keep]
    sizes = ends - starts + 1  # a space before each word
    to = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(to[-1], 0x20, np.uint8)
    spread = np.arange(to[-1]) - np.repeat(to[:-1], sizes)
    inner = spread > 0
    out[inner] = words.data[(np.repeat(starts, sizes) + spread - 1)[inner]]
    first = np.searchsorted(rows, np.arange(len(words.first)))
    at = to[first]
    view = out.tobytes()
    return [view[a + 1:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
