"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

A candidate is a run of at least ``LEAST`` characters that tokens and keys are
written with. The network reads the characters before it, its own and those after
it; over a longer run than ``INSIDE`` it slides in steps of half of that, and its largest
score counts. It is trained in numpy on labelled findings, of which a bounded sample by
hash is taken from the corpus: what the fixed patterns find, with and without the
characters before it, so that it must know a key by itself; candidates that they don't
touch, as counterexamples; keys of other kinds planted between the characters around
such candidates; and made-up keys, names, addresses and paths.

Its score is calibrated, and its threshold set, on findings it wasn't trained on: all of
a quarter of the corpus's candidates, by hash, and a quarter of the planted and made-up
ones. The threshold is one half or, if that doesn't find ``recall`` of the secrets of the
corpus and also of the others, the highest that does. Candidates above it are added whole, but those that the
fixed findings cover already, up to marks that are no letters or digits.

Defined cases: a null text is empty and has no spans; repeated rows are scanned
each; a null doc_id is kept; an empty table gives no rows; other columns are kept by
``redact`` and ignored by ``scan``. Spans are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, remove, small_batches, table
from ._textkernel import mix, pieces, utf8

# The patterns that findings of each kind must match, in this order.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "network")
CLUES = (b"passw", b"secret", b"token", b"api")

LEAST, BEFORE, INSIDE, AFTER = 12, 24, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
CANDIDATE = np.zeros(256, bool)
MARK = np.isin(np.arange(256), [ord(c) for c in "+/_.=-"])
CANDIDATE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
#: 48 classes of bytes: letters by case, digits in two halves, and marks of their own.
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = 1 + np.arange(26) % 13
CLASS[65:91] = 14 + np.arange(26) % 13
CLASS[97:103] = [27, 28, 29, 30, 31, 32]
CLASS[48:58] = [33, 33, 33, 33, 33, 34, 34, 34, 34, 34]
for _i, _c in enumerate(" \"'=:_-.+/@\n"):
    CLASS[ord(_c)] = 35 + _i
CLASS[128:] = 47
N_CLASSES, PAD = 49, 48


def windows(data: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Classes around candidates, padded beyond their document (low to high) and between the parts."""
    at = np.arange(WIDTH)
    from_start = start[:, None] + at[None, :] - BEFORE
    from_end = end[:, None] + at[None, :] - BEFORE - INSIDE
    place = np.where(at < BEFORE + INSIDE, from_start, from_end)
    ok = (place >= low[:, None]) & (place < high[:, None]) & ~((at >= BEFORE) & (at < BEFORE + INSIDE) & (from_start >= end[:, None]))
    return np.where(ok, CLASS[data[np.clip(place, 0, max(len(data) - 1, 0))]] if len(data) else PAD, PAD)


def slices(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping parts of at most ``INSIDE`` bytes that cover every candidate whole: their candidate, start and end."""
    step = INSIDE // 2
    count = 1 + np.maximum(0, -(-(end - start - INSIDE) // step))
    which = np.repeat(np.arange(len(start)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    low = np.maximum(np.minimum(start[which] + place * step, end[which] - INSIDE), start[which])
    return which, low, np.minimum(low + INSIDE, end[which])


class Network:
    """Embedded classes, one convolution, the largest response before, inside and after, and a logistic unit."""

    def __init__(self, filters: int = 24, wide: int = 5, deep: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.wide, self.deep = wide, deep
        self.p = {"e": rng.normal(0, 0.5, (N_CLASSES, deep)), "k": rng.normal(0, 0.3, (wide * deep, filters)), "kb": np.zeros(filters), "o": rng.normal(0, 0.2, 3 * filters), "ob": np.zeros(1)}
        half = wide // 2
        centre = np.arange(WIDTH - wide + 1) + half
        self.zones = [np.flatnonzero(centre < BEFORE), np.flatnonzero((centre >= BEFORE) & (centre < BEFORE + INSIDE)), np.flatnonzero(centre >= BEFORE + INSIDE)]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        cols = np.stack([e[:, i : i + WIDTH - self.wide + 1] for i in range(self.wide)], 2).reshape(len(x), WIDTH - self.wide + 1, -1)
        h = np.maximum(cols @ self.p["k"] + self.p["kb"], 0)
        best = [h[:, z].argmax(1) + z[0] for z in self.zones]
        top = np.concatenate([np.take_along_axis(h, b[:, None], 1)[:, 0] for b in best], 1)
        return cols, best, top, top @ self.p["o"] + self.p["ob"][0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logit(x) + self.shift, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, rate: float = 0.01, seed: int = 5) -> None:
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                cols, best, top, z = self._forward(x[at])
                d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[at]) * weight[at] / len(at)
                g = {"o": top.T @ d, "ob": np.array([d.sum()])}
                n = len(self.p["kb"])
                gk, gkb, ge = np.zeros_like(self.p["k"]), np.zeros(n), np.zeros_like(self.p["e"])
                for j, b in enumerate(best):
                    dh = d[:, None] * self.p["o"][j * n : (j + 1) * n] * (top[:, j * n : (j + 1) * n] > 0)
                    own = np.take_along_axis(cols, b[:, :, None], 1)  # examples x filters x (wide * deep)
                    gk += np.einsum("bf,bfc->cf", dh, own)
                    gkb += dh.sum(0)
                    back = (dh[:, :, None] * self.p["k"].T[None]).reshape(len(at), n, self.wide, self.deep)
                    for i in range(self.wide):
                        np.add.at(ge, np.take_along_axis(x[at], b + i, 1), back[:, :, i])
                g |= {"k": gk, "kb": gkb, "e": ge}
                step += 1
                for k, q in g.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * q
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * q * q
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray, groups: np.ndarray, recall: float) -> None:
        """A logistic curve over the logits, then the threshold: one half, or the highest below it with this recall in every group.

        The four arrays are a weighted sample: logits, labels, weights and the group that each is of.
        """
        weight = weight / np.maximum(np.where(y > 0, weight[y > 0].sum(), weight[y == 0].sum()), 1e-9)  # both labels alike
        a, b = 1.0, 0.0
        for _ in range(400):
            off = weight * (1 / (1 + np.exp(-np.clip(a * z + b, -50, 50))) - y)
            a, b = a - 0.05 * ((off * z).sum() + 1e-3 * a), b - 0.05 * off.sum()
        self.scale, self.shift, least = max(a, 1e-3), b, []
        for g in np.unique(groups[y > 0]):
            mine = np.flatnonzero((y > 0) & (groups == g))
            mine = mine[np.argsort(-z[mine], kind="stable")]
            reached = np.cumsum(weight[mine]) / weight[mine].sum()
            least.append(z[mine[min(np.searchsorted(reached, recall - 1e-9), len(mine) - 1)]])
        self.threshold = min(0.5, *(float(1 / (1 + np.exp(-np.clip(self.scale * x + self.shift, -50, 50)))) for x in least), 0.5)


def made_up(n: int, seed: int = 17) -> tuple[list[tuple[bytes, int, int]], np.ndarray]:
    """Findings of kinds that the fixed patterns don't know, with labels: (text, start, end) and 1 for secrets."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    every = low + up + digits
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "que", "cion", "sch", "ung", "ment", "tion", "ble", "eau", "ado"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    long_word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(6, 12)))
    secret = [
        lambda: ("", "sk_live_" + pick(every, r.randint(24, 34)), ""), lambda: ("", "ghp_" + pick(every, 36), ""), lambda: ("", "xoxb-" + pick(digits, 12) + "-" + pick(every, 24), ""),
        lambda: ("client_key: ", pick(every + "+/", r.randint(32, 44)), ""), lambda: ("Authorization: Bearer ", pick(every, 20) + "." + pick(every, 40) + "." + pick(every + "_-", 30), ""),
        lambda: ("aws_key = '", pick(every + "+/", 40), "'"), lambda: ("pass: ", pick(every, r.randint(16, 24)), ""),
    ]
    plain = [
        lambda: ("", long_word(), ""), lambda: ("", long_word().upper(), ""), lambda: ("", f"{word()}.{r.randint(1, 99)}", f"@mail{r.randint(0, 9)}.example.com"), lambda: ("https://www.", f"{long_word()}.example.com/{word()}/{r.randint(1, 9999)}", ""),
        lambda: ("", "/".join(word() for _ in range(5)) + ".html", ""), lambda: ("", "-".join(long_word() for _ in range(2)), ""), lambda: ("", f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T1{r.randint(0, 9)}.00.00", ""),
        lambda: ("", "_".join(word() for _ in range(5)) + str(r.randint(1, 99)), ""), lambda: ("", pick("=-_", 1) * r.randint(16, 40), ""), lambda: ("@", f"mail{r.randint(0, 9)}.{long_word()}.example.com", ""), lambda: ("", long_word() + ".", ""),
    ]
    out, labels = [], []
    for i in range(n):
        label = i % 2
        before, body, after = r.choice(secret if label else plain)()
        head = " ".join(word() for _ in range(5)) + " " + before
        out.append(((head + body + after + " " + " ".join(word() for _ in range(3))).encode(), len(head), len(head) + len(body)))
        labels.append(label)
    return out, np.array(labels)


def buried(n: int, seed: int = 23) -> list[tuple[bytes, int, int, int, int]]:
    """Long runs with a key somewhere in them: (text, start, end, the key's start, its end)."""
    r = random.Random(seed)
    every = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "que", "cion", "sch", "ung", "ment", "tion", "ble", "eau", "ado"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    out = []
    for _ in range(n):
        mark = r.choice("///.-_=")
        path = lambda least, most: mark.join(word() for _ in range(r.randint(least, most)))  # noqa: B023, E731
        head = r.choice([f"//{word()}.example.com/", f"/{word()}/", ""]) + path(3, 12) + mark
        key = "".join(r.choice(every) for _ in range(r.randint(20, 44)))
        tail = r.choice(["", mark + path(1, 10)])
        before = " ".join(word() for _ in range(5)) + r.choice([" ", " https:"])
        out.append((f"{before}{head}{key}{tail} {word()} {word()}".encode(), len(before), len(before + head + key + tail), len(before + head), len(before + head + key)))
    return out


@dataclass
class Found:
    """Spans of a piece of rows, in bytes of its buffer: (row, kind, start, end), and candidates with whether the spans leave some of them open."""

    data: np.ndarray
    offsets: np.ndarray
    spans: list[tuple[int, int, int, int]] = field(default_factory=list)
    start: np.ndarray = None
    end: np.ndarray = None
    row: np.ndarray = None
    covered: np.ndarray = None
    open: np.ndarray = None


def find(data: np.ndarray, offsets: np.ndarray) -> Found:
    """All fixed findings, and all candidates with whether these leave a letter or digit of them uncovered.

    Runs are found with numpy. A run of hexadecimal digits or of an access key lies
    inside a candidate, so those patterns only look there; the assignments are only
    looked for in rows that hold one of their words.
    """
    out = Found(data, offsets)
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = CANDIDATE[data]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    stop[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = end - start >= LEAST
    out.start, out.end = start[long], end[long]
    out.row = np.searchsorted(offsets, out.start, "right") - 1
    raw = data.tobytes()
    for a, b, row in zip(out.start.tolist(), out.end.tolist(), out.row.tolist(), strict=True):
        part = raw[a:b]
        if b"AKIA" in part:
            out.spans += [(row, 1, a + m.start(), a + m.end()) for m in ACCESS.finditer(part) if m.end() - m.start() >= 18]
        out.spans += [(row, 2, a + m.start(), a + m.end()) for m in HEX.finditer(part) if m.end() - m.start() >= 16]
    small = raw.lower()
    rows = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for clue in CLUES for m in re.finditer(clue, small)}
    for row in rows:
        a = int(offsets[row])
        out.spans += [(row, 0, a + m.start(), a + m.end()) for m in ASSIGN.finditer(raw[a : int(offsets[row + 1])]) if len(m[2]) >= 12]
    cover = np.zeros(n + 1, np.int64)
    for _, _, a, b in out.spans:
        cover[a] += 1
        cover[b] -= 1
    inside = np.cumsum(cover[:n]) > 0
    out.covered = np.concatenate([[0], np.cumsum(inside)])
    left = np.concatenate([[0], np.cumsum(~inside & ~MARK[data])])
    out.open = left[out.end] > left[out.start]
    return out


def _windows(f: Found, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates: the windows of all slices, and the place in ``which`` that each belongs to."""
    of, start, end = slices(f.start[which], f.end[which])
    row = f.row[which][of]
    return windows(f.data, start, end, f.offsets[row], f.offsets[row + 1]), of


def _scores(f: Found, which: np.ndarray, network: Network, some: int = 4096) -> np.ndarray:
    """The largest score of each candidate's slices."""
    out = np.zeros(len(which))
    for i in range(0, len(which), some):
        x, of = _windows(f, which[i : i + some])
        np.maximum.at(out, i + of, network.chance(x))
    return out


def _parts(column: pa.Array):
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        yield a, b, find(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


#: Bins of logits for the calibration on the corpus.
LOGITS = np.linspace(-24, 24, 961)


def _labelled(f: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and hashes of all slices that the fixed findings fill, or don't touch."""
    of, low, high = slices(f.start, f.end)
    shown = f.covered[high] - f.covered[low]
    sure = (shown == 0) | (shown >= LEAST)
    of, low, high, shown = of[sure], low[sure], high[sure], shown[sure]
    row = f.row[of]
    x = windows(f.data, low, high, f.offsets[row], f.offsets[row + 1]).astype(np.uint8)
    wide = np.zeros((len(x), WIDTH // 8), np.uint64)
    wide[:] = np.ascontiguousarray(x).view(np.uint64)
    order = mix((wide * (np.arange(1, WIDTH // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(1, dtype=np.uint64))
    return x, shown > 0, order >> np.uint64(1)


def findings(docs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of at most ``most`` different slices of each label: those with the smallest hashes but a quarter of all, which are kept apart. One scan."""

    def run(batches):
        held = [np.zeros((0, WIDTH), np.uint8)] * 2, [np.zeros(0, np.uint64)] * 2
        for batch in batches:
            for _, _, f in _parts(batch.column(0)):
                x, y, o = _labelled(f)
                for k in (0, 1):
                    mine = (y == k) & (o % np.uint64(4) > 0)
                    o_all, first = np.unique(np.concatenate([held[1][k], o[mine]]), return_index=True)
                    held[0][k], held[1][k] = np.concatenate([held[0][k], x[mine]])[first[:most]], o_all[:most]
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in held[0][k]], pa.binary()), pa.array(np.full(len(held[1][k]), k, np.int32)), pa.array(held[1][k].astype(np.int64))], ["x", "y", "o"])

    small_batches(docs.sparkSession)
    rows = cut(docs.select(F.col("text").cast("string")).mapInArrow(run, "x binary, y int, o long"), "findings")
    got = [r for y in (1, 0) for r in rows.where(F.col("y") == y).groupBy("o").agg(F.first("x").alias("x"), F.first("y").alias("y")).orderBy("o").limit(most).collect()]
    remove(docs.sparkSession, rows)
    return np.array([np.frombuffer(r["x"], np.uint8) for r in got], np.int64).reshape(len(got), WIDTH), np.array([r["y"] for r in got], np.int64)


def spread(docs: DataFrame, network: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits (centres of bins), labels and numbers of all the corpus's slices that were kept apart."""
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            total = np.zeros((2, len(LOGITS) + 1), np.int64)
            for _, _, f in _parts(batch.column(0)):
                x, y, o = _labelled(f)
                apart = np.flatnonzero(o % np.uint64(4) == 0)
                for i in range(0, len(apart), 4096):
                    at = apart[i : i + 4096]
                    np.add.at(total, (y[at].astype(np.int64), np.searchsorted(LOGITS, model.value.logit(x[at].astype(np.int64)))), 1)
            label, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(place), pa.array(total[label, place])], ["y", "at", "n"])

    small_batches(docs.sparkSession)
    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "y long, at long, n long").groupBy("y", "at").agg(F.sum("n").alias("n")).collect()  # two rows a bin at most
    edges = np.concatenate([LOGITS[:1], LOGITS])  # a bin counts as its lower end
    return np.array([edges[r["at"]] for r in got]), np.array([r["y"] for r in got], float), np.array([r["n"] for r in got], float)


def planted(x: np.ndarray, y: np.ndarray, n: int, seed: int = 31) -> np.ndarray:
    """Windows of keys of other kinds between the characters around candidates of the corpus that are no secrets."""
    plain = x[y == 0]
    keys, labels = made_up(2 * n, seed)
    keys = [t[a:b] for (t, a, b), one in zip(keys, labels, strict=True) if one]
    if not len(plain):
        return plain
    rng, out = np.random.default_rng(seed), np.full((len(keys), WIDTH), PAD)
    for i, key in enumerate(keys):
        one = plain[rng.integers(len(plain))]
        at = int(rng.integers(0, max(1, len(key) - INSIDE + 1))) if rng.integers(2) else 0
        part = CLASS[np.frombuffer(key[at : at + INSIDE], np.uint8)]
        out[i, :BEFORE] = one[:BEFORE] if at < BEFORE else CLASS[np.frombuffer(key[at - BEFORE : at], np.uint8)]
        out[i, BEFORE : BEFORE + len(part)] = part
        out[i, BEFORE + INSIDE :] = one[BEFORE + INSIDE :]
    return out


def train(docs: DataFrame, most: int = 1500, artificial: int = 2000, recall: float = 0.99) -> Network:
    """The network, its calibration and threshold. It is fitted to at most 2 * most labelled slices of the corpus, each secret also without what precedes it, and the planted and made-up ones."""
    x, y = findings(docs, most)
    bare = x[y == 1].copy()
    bare[:, :BEFORE] = PAD
    other = planted(x, y, artificial // 2)
    made, labels = made_up(artificial)
    mine, label = [other], [1] * len(other)
    for (t, a, b), one in zip(made, labels, strict=True):
        _, low, high = slices(np.array([a]), np.array([b]))
        mine.append(windows(np.frombuffer(t, np.uint8), low, high, np.zeros_like(low), np.full_like(low, len(t))))
        label += [one] * len(low)
    for t, a, b, c, d in buried(artificial // 2):
        _, low, high = slices(np.array([a]), np.array([b]))
        shown = np.minimum(high, d) - np.maximum(low, c)
        sure = (shown <= 0) | (shown >= INSIDE // 4)  # a few bytes of a key are neither
        mine.append(windows(np.frombuffer(t, np.uint8), low[sure], high[sure], np.zeros_like(low[sure]), np.full_like(low[sure], len(t))))
        label += (shown[sure] > 0).astype(int).tolist()
    own, own_y = np.concatenate(mine), np.array(label, float)
    order = np.random.default_rng(1).permutation(len(own))
    own, own_y = own[order], own_y[order]
    apart = np.arange(len(own)) % 4 == 0
    fit_x, fit_y = np.concatenate([x, bare, own[~apart]]), np.concatenate([y, np.ones(len(bare)), own_y[~apart]]).astype(float)
    network = Network()
    order = np.random.default_rng(2).permutation(len(fit_x))
    network.fit(fit_x[order], fit_y[order])
    # a corpus holds secrets that the patterns miss: its counterexamples that look like some are left out of the second fit
    doubtful = np.zeros(len(fit_x), bool)
    doubtful[: len(x)] = (y == 0) & (network.logit(x) > 0)
    order, network = order[~doubtful[order]], Network()
    network.fit(fit_x[order], fit_y[order])
    z, one, n = spread(docs, network)
    network.calibrate(np.concatenate([z, network.logit(own[apart])]), np.concatenate([one, own_y[apart]]), np.concatenate([n, np.ones(int(apart.sum()))]), np.repeat([0, 1], [len(z), int(apart.sum())]), recall)
    return network


def _spans(f: Found, network: Network) -> list[list[tuple[int, int, int]]]:
    """Each row's (start, kind, end) in code points, by start and then kind."""
    open_ = np.flatnonzero(f.open)
    added = open_[_scores(f, open_, network) >= network.threshold]
    spans = f.spans + [(int(f.row[i]), 3, int(f.start[i]), int(f.end[i])) for i in added]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(f.offsets) - 1)]
    points = np.concatenate([[0], np.cumsum((f.data & 0xC0) != 0x80)])
    for row, kind, a, b in spans:
        zero = points[f.offsets[row]]
        out[row].append((int(points[a] - zero), kind, int(points[b] - zero)))
    return [sorted(x) for x in out]


def _text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document."""
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            for a, b, f in _parts(batch.column(1)):
                spans = _spans(f, model.value)
                count = lambda k: pa.array([sum(x[1] == k for x in s) for s in spans], pa.int64())  # noqa: B023, E731
                base = [hashlib.sha256(_text([x for x in s if x[1] < 3]).encode()).hexdigest() for s in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), count(0), count(1), count(2), pa.array(base), pa.array([_text(s) for s in spans])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, network: Network, mark: str = "[secret]", count: str | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced; a null text stays null. The column ``count``, if there, has the length of a text that changed."""
    model, at = docs.sparkSession.sparkContext.broadcast(network), docs.columns.index("text")
    counted = docs.columns.index(count) if count in docs.columns else -1

    def clean(text: str, spans) -> str:
        out, place = [], 0
        for a, _, b in spans:
            if b > place:
                out += [text[place:a], mark] if a >= place else []
                place = b
        return "".join([*out, text[place:]])

    def run(batches):
        for batch in batches:
            texts: list[str | None] = []
            for a, b, f in _parts(batch.column(at)):
                texts += [clean(t, s) if s else t for t, s in zip(batch.column(at)[a:b].to_pylist(), _spans(f, model.value), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if counted >= 0:
                changed = pc.not_equal(columns[at], batch.column(at))
                columns[counted] = pc.if_else(pc.fill_null(changed, False), pc.utf8_length(columns[at]).cast(columns[counted].type), columns[counted])
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
