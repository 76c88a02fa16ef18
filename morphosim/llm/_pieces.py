"""A lower-casing word-end BPE over whole Arrow columns, with each distinct piece encoded once.

Pieces (runs of letters, single digits, runs of other characters, a few English
endings after an apostrophe) are cut and hashed as bytes with numpy; their ids
come from a hash table in numpy, which a worker keeps from batch to batch. Only
new pieces reach the library. Texts whose characters are not all ASCII or Latin-1
letters, or that hold a special token, go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from ._textkernel import BYTE_VALUE, mix, pieces, powers, utf8

U64 = np.uint64
LETTER, DIGIT, OTHER, BLANK = 0, 1, 2, 3
KIND = np.full(256, OTHER, np.uint8)
KIND[48:58] = DIGIT
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KIND[[*range(9, 14), 32]] = BLANK
#: What the tokenizer's own split takes together with an apostrophe before it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class HashTable:
    """64-bit keys to consecutive numbers, by vectorised open addressing."""

    def __init__(self, bits: int):
        self.mask, self.keys, self.values, self.size = U64((1 << bits) - 1), np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        slot = keys & self.mask
        out, held = self.values[slot], self.keys[slot]
        lost = np.flatnonzero((held != keys) & (out >= 0))
        while len(lost):
            slot[lost] = (slot[lost] + U64(1)) & self.mask
            at = slot[lost]
            out[lost] = self.values[at]
            lost = lost[(self.keys[at] != keys[lost]) & (out[lost] >= 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number distinct new keys on from the last."""
        numbers, slot = np.arange(self.size, self.size + len(keys), dtype=np.int32), keys & self.mask
        self.size += len(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.values[slot[todo]] < 0]
            self.values[slot[free]] = numbers[free]  # of keys that meet here, the last stays
            won = self.values[slot[todo]] == numbers[todo]
            self.keys[slot[todo[won]]] = keys[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + U64(1)) & self.mask


class PieceEncoder:
    """Ids of whole columns of texts, for a tokenizer file of this kind."""

    def __init__(self, path: str, bits: int = 21):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.bits, self.letters = Tokenizer.from_file(path), bits, byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.table, self.most = HashTable(self.bits), (1 << self.bits) * 2 // 5
        self.flat, self.used, self.first = np.zeros(1 << 20, np.uint32), 0, np.zeros(self.most + 2, np.int64)

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        out, ends = [], []
        for word in words:
            out += [t.id for t in tokenize(word.decode() if word.isalnum() else "".join([letters[b] for b in word]))]
            ends.append(len(out))
        while self.used + len(out) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(out)] = out
        n = self.table.size
        self.first[n + 1 : n + 1 + len(words)] = self.used + np.array(ends, np.int64)
        self.used += len(out)
        self.table.add(keys)

    def _cut(self, data: np.ndarray, offsets: np.ndarray):
        """Start and end of each piece in lower-cased bytes."""
        n, kind = len(data), KIND[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = edge[:n].copy()
        start[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        quote = np.flatnonzero((data[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~edge[1:n]) if n > 1 else np.zeros(0, int)
        if len(quote):
            padded, wall = np.concatenate([data, np.zeros(2, np.uint8)]), np.concatenate([edge, np.ones(2, bool)])
            a, b = padded[quote + 1], np.where(wall[quote + 2], 0, padded[quote + 2])
            size = np.zeros(len(quote), np.int64)
            for e in ENDINGS:
                size[(size == 0) & (a == ord(e[0])) & ((b == ord(e[-1])) | (len(e) == 1))] = len(e)
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            after = quote + 1 + size
            start[after[after < n]] = True
        at = np.flatnonzero(start)
        stop = np.concatenate([at[1:], [n]]) if n else at
        solid = kind[at] != BLANK
        return at[solid], stop[solid]

    def _quick(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in a row, and each row's first place in them."""
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        if len(data) > 1:
            after = np.zeros(len(data), bool)
            after[1:] = (data[:-1] == 0xC3) & (data[1:] <= 0x9E)
            low[after] += np.uint8(32)
        start, end = self._cut(low, offsets)
        up, down = powers(len(low))
        total = np.zeros(len(low) + 1, U64)
        np.cumsum(BYTE_VALUE[low] * up[: len(low)], out=total[1:])
        keys = mix((total[end] - total[start]) * down[start])
        found = self.table.find(keys)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            new, where = np.unique(keys[lost], return_index=True)
            if self.table.size + len(new) > self.most:
                self.clear()
                new, where = np.unique(keys, return_index=True)
                lost = np.arange(len(keys))
            if len(new) > self.most:
                raise OverflowError("more distinct pieces in one batch than the table holds")
            raw = low.tobytes()
            self.learn(new, [raw[start[i] : end[i]] for i in lost[where]])
            found = self.table.find(keys)
        size = self.first[found + 1] - self.first[found]
        into = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.first[found] - into[:-1], size) + np.arange(into[-1])]
        return ids, into[np.searchsorted(start, offsets)]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Each text's ids, unsigned 32 bits; null counts as empty."""
        data, offsets = utf8(column)
        out: list[np.ndarray] = []
        for a, b in pieces(offsets, 2 << 20):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            odd = part >= 0x80
            if odd.any():  # beyond ASCII, only the two bytes of Latin-1 letters are known here
                lead = part == 0xC3
                tail = np.zeros(len(part), bool)
                tail[1:] = lead[:-1]
                odd &= ~lead & ~tail | tail & ((part == 0x97) | (part == 0xB7))
            bad = np.diff(np.concatenate([[0], np.cumsum(odd)])[off]) > 0
            raw = part.tobytes()
            for special in self.special:
                at = raw.find(special.encode())
                while at >= 0:
                    bad[np.searchsorted(off, at, "right") - 1] = True
                    at = raw.find(special.encode(), at + 1)
            size = np.diff(off)
            good = np.where(bad, 0, size)
            keep = np.repeat(~bad, size)
            try:
                ids, first = self._quick(part[keep] if bad.any() else part, np.concatenate([[0], np.cumsum(good)]))
            except OverflowError:  # too many distinct pieces: texts go whole to the library
                bad[:] = True
            for i in range(b - a):
                out.append(np.array(self.tokenizer.encode(raw[off[i] : off[i + 1]].decode(), add_special_tokens=False).ids, np.uint32) if bad[i] else ids[first[i] : first[i + 1]])
        return out


_KEPT: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a file; it keeps what it has learnt from task to task."""
    if path not in _KEPT:
        _KEPT[path] = PieceEncoder(path)
    return _KEPT[path]
