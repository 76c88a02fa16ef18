"""The pairs with the least md5 of "seed:query:target", found in numpy: the first word of a hash tells almost all pairs apart."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFT = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
#: Pairs hashed at a time: some six arrays of as many words stay near the core. A message with its end has to fit one block.
PIECE, LONGEST = 32768, 55


def _word(i: int) -> int:
    return (i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16]


def _words(text: np.ndarray, at: int, size: int) -> dict[int, np.ndarray]:
    """By number, the 32-bit words of a block that ``size`` bytes of each text touch, when they stand at ``at``."""
    block = np.zeros((len(text), 64), np.uint8)
    block[:, at : at + size] = text[:, :size]
    return {i: block.view("<u4")[:, i].astype(np.uint32) for i in range(at // 4, (at + size - 1) // 4 + 1)}


def first_words(left: dict[int, np.ndarray], right: dict[int, np.ndarray], size: int) -> np.ndarray:
    """The first eight hexadecimal digits, as a number, of the md5 of ``size`` bytes, whose words are sums of both sides' (of shapes that fit)."""
    shape = np.broadcast_shapes(*[w.shape for w in (*left.values(), *right.values())])
    k = lambda v: np.full((1,) * len(shape), v & 0xFFFFFFFF, np.uint32)
    a, b, c, d = (np.array(np.broadcast_to(k(v), shape)) for v in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the first word is final three steps before the end
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        w = _word(i)
        constant = k(_K[i] + (8 * size if w == 14 else 0))
        f += left[w] + constant if w in left else constant
        if w in right:
            f += right[w]
        s = _SHIFT[i // 16][i % 4]
        np.left_shift(f, np.uint32(s), out=g), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, g, out=f)
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += k(_START[0])
    return b.byteswap()


def _by_length(ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of ids of equal length as text: the length, the ids and their bytes."""
    text = ids.astype("S20")
    size = np.char.str_len(text)
    return [(int(n), ids[size == n], np.ascontiguousarray(text[size == n]).view(np.uint8).reshape(-1, 20)) for n in np.unique(size)]


class Least:
    """At least the n pairs with the least hashes of those seen, each once: more only where first words are equal."""

    def __init__(self, n: int, seed: int):
        self.n, self.head, self.bound = n, np.frombuffer(f"{seed}:".encode(), np.uint8), np.uint32(2**32 - 1)
        self.kept, self.more = np.empty((0, 3), np.int64), []
        self.waiting = 0

    def add(self, q: np.ndarray, t: np.ndarray) -> None:
        """All pairs of different ids of both."""
        for q_size, q_ids, q_text in _by_length(q):
            before = len(self.head) + q_size + 1
            text = np.concatenate([np.broadcast_to(self.head, (len(q_ids), len(self.head))), q_text[:, :q_size], np.full((len(q_ids), 1), ord(":"), np.uint8)], 1)
            left = _words(text, 0, before)
            for t_size, t_ids, t_text in _by_length(t):
                right = _words(np.concatenate([t_text[:, :t_size], np.full((len(t_ids), 1), 0x80, np.uint8)], 1), before, t_size + 1)
                step = max(1, PIECE // len(t_ids))
                for a in range(0, len(q_ids), step):
                    word = first_words({i: w[a : a + step, None] for i, w in left.items()}, {i: w[None] for i, w in right.items()}, before + t_size)
                    row, column = np.nonzero(word <= self.bound)
                    if len(row):
                        self._keep(np.stack([word[row, column].astype(np.int64), q_ids[row + a], t_ids[column]], 1))

    def _keep(self, rows: np.ndarray) -> None:
        rows = rows[rows[:, 1] != rows[:, 2]]
        self.more.append(rows)
        self.waiting += len(rows)
        if self.waiting > 2 * self.n:
            self.settle()

    def settle(self) -> None:
        rows = np.unique(np.concatenate([self.kept, *self.more]), axis=0)
        if self.n and len(rows) > self.n:
            self.bound = np.uint32(rows[self.n - 1, 0])
            rows = rows[rows[:, 0] <= self.bound]
        self.kept, self.more, self.waiting = rows, [], 0


def least(n: int, seed: int):
    """A function for mapInArrow, from tiles (q, t: arrays of ids) to query_id, target_id: the least of a task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Least(n, seed)
        for batch in batches:
            for q, t in zip(batch.column("q"), batch.column("t"), strict=True):
                found.add(*(x.values.to_numpy().astype(np.int64) for x in (q, t)))
        found.settle()
        yield pa.RecordBatch.from_arrays([pa.array(found.kept[:, 1]), pa.array(found.kept[:, 2])], ["query_id", "target_id"])

    return run
