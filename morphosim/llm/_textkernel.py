"""Vectorised tokenising and hashing of the UTF-8 bytes of an Arrow string column.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
A word's hash is polynomial modulo 2**64, taken from prefix sums over the
whole buffer, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(0x5EED)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUE = BYTE_VALUE[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, BASE, U64), np.full(n + 1, INVERSE, U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(n).bit_length()))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes each; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """The words of some rows: ``start`` and ``end`` in ``data``, ``row``, ``hash``; ``first[i]`` is row i's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        solid = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | edge[1:n]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)
        up, down = powers(n)
        total = np.zeros(n + 1, U64)
        np.cumsum(LOWER_VALUE[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within it, and the first place of each row.

    A row with fewer words than ``size`` but not none has its whole sequence as one shingle.
    """
    up, _ = powers(64)
    h, n = words.hash, words.count
    take = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    first = np.concatenate([[0], np.cumsum(take)])
    row = np.repeat(np.arange(words.rows), take)
    at = words.first[row] + np.arange(first[-1]) - first[row]
    left = words.first[row + 1] - at
    out = np.zeros(len(at), U64)
    padded = np.concatenate([h, np.zeros(size, U64)])
    for j in range(size):
        out += np.where(left > j, padded[at + j] * up[size - j], U64(0))
    out = mix(out + np.minimum(n[row], size).astype(U64))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):  # short sorts of a row each are quicker than one of all
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(words.rows + 1))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
