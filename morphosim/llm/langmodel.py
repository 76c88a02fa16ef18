"""Deleted interpolation: word n-grams of orders 0 to 3, mixed by context-frequency buckets.

Tokens are the words of a text, lower-cased, then an end. Symbols are the training
tokens and one unknown token. A text starts after two ends. The model:

    P(w | u, v) = l3 * N(u, v, w)/N(u, v) + l2 * N(v, w)/N(v) + l1 * P(w) + l0 / symbols
    P(w) = m * N(w)/N, and 1 - m for the unknown token

The weights l depend on how frequent both contexts are (a bucket for each factor of
four of each count; l3 or l2 is 0 after a context never seen) and are learned by
expectation-maximisation on held-out counts: one training document in ``folds`` is
kept apart, the counts of the others give the estimates, its counts the likelihood; m
is the share of held-out tokens that the others know. For scoring, both are added up.
The probabilities of all symbols after a context sum to 1, over the same symbols as
the base score's.

How it runs: texts are read once, into chunks of about ``chunk`` tokens, held-out
documents apart from the others. A chunk is one row of a Parquet table: its vocabulary
of token hashes and its tokens as places in it. From it come the chunk's distinct
n-grams of all orders as sorted 64-bit hashes with their counts, dealt by hash into
buckets of about ``bucket`` n-grams, a packed row for each chunk and bucket. There the
counts of all chunks are added, and each gets back, packed in the same order, the
counts of what it sent. A chunk's n-grams and the counts then meet once for the
held-out chunks, which give the expectation step's table, and once for all, which
gives the scores. Frequent n-grams are counted within the chunk before anything moves,
so no key is hot; only the sums of the expectation step, a few hundred numbers, and the
model's totals reach the driver, and only these and the weights the tasks.

N-grams whose hashes agree in ``BITS`` bits are taken for one: some 700 pairs of 10**10
distinct ones.

Defined cases: a null text is empty and has the end token alone; a null id counts
as the empty text for the split; repeated rows are scored (and learned from) each;
an empty table gives no rows; without training rows every word is new; a very long
text is a chunk of its own; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._packed import expand, join_parts, split_parts, squeeze
from ._shared import cut, doc_crc, remove, small_batches, table
from ._textkernel import Words, as_long, mix, pieces, utf8

U64 = np.uint64
END = U64(0x656E64 << 32)  # the end token's hash
BASE = U64(0x9E3779B97F4A7C15)
FIT, HELD, TEST = 0, 1, 2
BITS = 56
CHUNK = "chunk long, held boolean, tokens long, body binary"


@dataclass(frozen=True)
class Settings:
    folds: int = 8
    rounds: int = 25
    classes: int = 8
    chunk: int = 1_500_000
    bucket: int = 1_000_000


class Chunk:
    """Documents of one kind of part: ``rows`` (doc_id, whether it is null, whether it is a test one, tokens) and the tokens of all in a row."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, test: np.ndarray, count: np.ndarray, vocabulary: np.ndarray, at: np.ndarray):
        self.ids, self.null, self.test, self.count, self.vocabulary, self.at = ids, null, test, count, vocabulary, at

    def packed(self) -> bytes:
        # common tokens get small numbers, which pack better
        often = np.argsort(-np.bincount(self.at, minlength=len(self.vocabulary)), kind="stable")
        number = np.empty(len(often), np.int64)
        number[often] = np.arange(len(often))
        return join_parts(squeeze(x) for x in (self.ids, self.null, self.test, self.count, np.diff(self.vocabulary, prepend=U64(0)), often, number[self.at]))

    @classmethod
    def of(cls, body: bytes) -> Chunk:
        ids, null, test, count, steps, often, number = (expand(p) for p in split_parts(body))
        return cls(ids.view(np.int64), null > 0, test > 0, count.astype(np.int64), np.cumsum(steps, dtype=U64), often.astype(np.int64)[number.astype(np.int64)])

    def grams(self) -> Iterator[np.ndarray]:
        """The hash of the pair, then of the three tokens, that end at each token."""
        word, first = self.vocabulary[self.at], self.starts()
        one = np.concatenate([[END], word[:-1]])
        one[first] = END
        pair = mix(mix(one) * BASE + word)
        del word
        yield pair >> U64(64 - BITS)
        two = np.concatenate([[END], one[:-1]])
        two[first] = END
        del one
        yield mix(mix(two * BASE + U64(3)) * BASE + pair) >> U64(64 - BITS)

    def starts(self) -> np.ndarray:
        """Each document's first token; every document has one."""
        return np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)


def chunks(docs: DataFrame, s: Settings) -> DataFrame:
    """Every document's tokens, in chunks."""
    c = doc_crc(F.col("doc_id"))
    part = F.when(c % 7 == 2, TEST).when((c / 7).cast("long") % s.folds == 0, HELD).otherwise(FIT)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.cast("int").alias("part"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("chunk", pa.int64()), ("held", pa.bool_()), ("tokens", pa.int64()), ("body", pa.binary())])
    limit = s.chunk

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        open_: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def close(held: bool) -> pa.RecordBatch:
            nonlocal number
            ids, null, test, count, words = (np.concatenate(x) for x in zip(*open_[held], strict=True))
            vocabulary, at = np.unique(words >> U64(64 - BITS), return_inverse=True)
            body = Chunk(ids, null, test, count, vocabulary, at).packed()
            n, open_[held], size[held] = size[held], [], 0
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([held]), pa.array([n], pa.int64()), pa.array([body], pa.binary())], schema=schema)

        for batch in batches:
            data, offsets = utf8(batch.column(2))
            null = np.asarray(batch.column(0).is_null())
            ids, kind = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in pieces(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                # every text's words, then its end
                ended = np.insert(words.hash, words.first[1:], END)
                row = np.repeat(np.arange(b - a), words.count + 1)
                for held in (False, True):
                    mine = (kind[a:b] == HELD) == held
                    if mine.any():
                        if size[held] and size[held] + int((words.count[mine] + 1).sum()) > limit:
                            yield close(held)
                        open_[held].append((ids[a:b][mine], null[a:b][mine], kind[a:b][mine] == TEST, words.count[mine] + 1, ended[mine[row]]))
                        size[held] += int((words.count[mine] + 1).sum())
        for held in (False, True):
            if open_[held]:
                yield close(held)

    small_batches(docs.sparkSession)
    return cut(rows.mapInArrow(run, CHUNK), "chunks")


def _distinct(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each is counted."""
    if counted.all():
        keys = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[edge], np.diff(np.append(edge, len(keys)))
    asked, times = _distinct(keys, np.ones(len(keys), bool))
    known, n = _distinct(keys[counted], np.ones(int(counted.sum()), bool))
    out = np.zeros(len(asked), np.int64)
    out[np.searchsorted(asked, known)] = n
    return asked, out


def _limits(buckets: int) -> np.ndarray:
    """The first hash of each bucket but the first."""
    return np.array([(i << BITS) // buckets for i in range(1, buckets)], U64)


def requests(chunked: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, held, body: of each chunk and bucket the n-grams of three orders as steps between sorted hashes, and their counts."""
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("held", pa.bool_()), ("body", pa.binary())])

    def run(batches):
        limits = _limits(buckets)
        for batch in batches:
            for name, held, _, body in zip(*batch.columns, strict=True):
                c = Chunk.of(body.as_py())
                trained = ~np.repeat(c.test, c.count)
                found = [(c.vocabulary, np.bincount(c.at, trained, len(c.vocabulary)).astype(np.int64)), *(_distinct(g, trained) for g in c.grams())]
                edges = [np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]]) for keys, _ in found]
                some = max(1, (8 << 20) * buckets // (1 + sum(16 * len(k) for k, _ in found)))
                for a in range(0, buckets, some):
                    which = range(a, min(a + some, buckets))
                    bodies = [join_parts(squeeze(x) for (keys, n), e in zip(found, edges, strict=True) for x in (np.diff(keys[e[i] : e[i + 1]], prepend=U64(0)), n[e[i] : e[i + 1]])) for i in which]
                    k = len(bodies)
                    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([name.as_py()] * k, pa.int64()), pa.array([held.as_py()] * k), pa.array(bodies, pa.binary())], schema=schema)

    return chunked.mapInArrow(run, "bucket long, chunk long, held boolean, body binary")


def answers(asked: DataFrame) -> DataFrame:
    """chunk, held, bucket, body: the counts of all training documents of what each chunk asked for, and of those that aren't held out if the chunk is.

    A row with a null chunk has a bucket's totals: fit, held_out, distinct, fit_distinct, seen.
    """
    totals = ("fit", "held_out", "distinct", "fit_distinct", "seen")
    schema = pa.schema([("chunk", pa.int64()), ("held", pa.bool_()), ("bucket", pa.int64()), ("body", pa.binary()), *((t, pa.int64()) for t in totals)])

    def run(group: pa.Table) -> pa.Table:
        held, bodies = group.column("held").to_pylist(), group.column("body").to_pylist()
        parts = [split_parts(b) for b in bodies]
        back: list[list[bytes]] = [[] for _ in bodies]
        sums = [0] * 5
        for order in range(3):
            keys = [np.cumsum(expand(p[2 * order]), dtype=U64) for p in parts]
            counts = [expand(p[2 * order + 1]).astype(np.int64) for p in parts]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            every = np.concatenate(keys)
            by = np.argsort(every, kind="stable")  # sorted runs are merged
            edge = np.concatenate([[True], every[by[1:]] != every[by[:-1]]])[: len(every)]
            place = np.empty(len(every), np.int64)
            place[by] = np.cumsum(edge) - 1
            kinds = int(edge.sum())
            fit, out = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64)
            for i, n in enumerate(counts):
                where = place[ends[i] : ends[i + 1]]
                (out if held[i] else fit)[where] += n  # a chunk's keys are distinct
            if order == 0:
                sums = [int(x) for x in (fit.sum(), out.sum(), (fit + out > 0).sum(), (fit > 0).sum(), out[fit > 0].sum())]
            for i in range(len(bodies)):
                where = place[ends[i] : ends[i + 1]]
                back[i] += [squeeze((fit + out)[where]), squeeze(fit[where] if held[i] else fit[:0])]
        n, empty = len(bodies), pa.nulls(len(bodies), pa.int64())
        rows = pa.table([group.column("chunk").combine_chunks(), pa.array(held), group.column("bucket").combine_chunks(), pa.array([join_parts(b) for b in back], pa.binary()), *[empty] * 5], schema=schema)
        return pa.concat_tables([rows, pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), group.column("bucket").slice(0, 1).combine_chunks(), pa.nulls(1, pa.binary()), *(pa.array([x], pa.int64()) for x in sums)], schema=schema)]) if n else schema.empty_table()

    kinds = "chunk long, held boolean, bucket long, body binary, " + ", ".join(f"{t} long" for t in totals)
    return cut(asked.groupBy("bucket").applyInArrow(run, kinds), "answers")


@dataclass
class Model:
    """Totals of the training tokens, the known share of new ones, and the weights of orders 0 to 3 by class of both contexts."""

    total: int
    distinct: int
    known: float
    documents: int
    classes: int
    lam: np.ndarray | None = None

    def parts(self, c: Chunk, counts: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Each token's class, the estimates of orders 1 to 3, and its own count."""
        word, pair, three = counts
        before, both = np.concatenate([[0], word[:-1]]), np.concatenate([[0], pair[:-1]])
        before[starts] = both[starts] = self.documents
        one = np.where(word > 0, self.known * word / max(self.total, 1), 1 - self.known)
        return class_of(both, self.classes) * self.classes + class_of(before, self.classes), [one, pair / np.maximum(before, 1), three / np.maximum(both, 1)], word


def class_of(count: np.ndarray, classes: int) -> np.ndarray:
    """0 for contexts never seen, then one for each factor of four."""
    return np.where(count > 0, np.minimum(1 + np.log2(np.maximum(count, 1)).astype(np.int64) // 2, classes - 1), 0)


def _counts(c: Chunk, buckets: np.ndarray, bodies: list[bytes], own: bool) -> list[np.ndarray]:
    """For each order, the count of the n-gram that ends at each token: of all training documents or, if ``own``, of those not held out."""
    parts = [split_parts(bodies[i]) for i in np.argsort(buckets)]
    counts = [np.concatenate([expand(p[2 * order + own]) for p in parts]).astype(np.int64) for order in range(3)]
    out = [counts[0][c.at]]
    for grams, n in zip(c.grams(), counts[1:], strict=True):
        _, at = np.unique(grams, return_inverse=True)
        out.append(n[at])
    return out


def _met(chunked: DataFrame, answered: DataFrame, kernel, kinds: str) -> DataFrame:
    """Run ``kernel(chunk, buckets, bodies)`` for each chunk with all answers that it got; it gives a table."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return kernel(Chunk.of(left.column("body")[0].as_py()), right.column("bucket").to_numpy(), right.column("body").to_pylist())

    right = answered.where("chunk is not null").select("chunk", "bucket", "body")
    return chunked.select("chunk", "body").groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(lambda a, b: run(a, b), kinds)


def held_out(chunked: DataFrame, answered: DataFrame, apart: Model) -> DataFrame:
    """class, p1, p2, p3, n: the held-out tokens, those of a chunk with equal estimates and class as one row."""

    def kernel(c: Chunk, buckets, bodies) -> pa.Table:
        kind, parts, _ = apart.parts(c, _counts(c, buckets, bodies, True), c.starts())
        by = np.lexsort((parts[0], parts[1], parts[2], kind))
        columns = [x[by] for x in (kind, *parts)]
        edge = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], 0)]))
        n = np.diff(np.append(edge, len(kind)))
        return pa.table([pa.array(columns[0][edge].astype(np.int32)), *(pa.array(x[edge].astype(np.float32)) for x in columns[1:]), pa.array(n)], names=["class", "p1", "p2", "p3", "n"])

    return cut(_met(chunked.where("held"), answered.where("held"), kernel, "class int, p1 float, p2 float, p3 float, n long"), "held-out")


def weights(events: DataFrame, model: Model, rounds: int, near: float = 1e-4) -> np.ndarray:
    """Mixture weights (classes x orders) by expectation-maximisation, until no weight moves by ``near``."""
    k = model.classes
    lam = np.full((k * k, 4), 0.25)
    lam[:k, 3] = 0  # contexts never seen have no n-grams
    lam[::k, 2:] = 0
    lam /= lam.sum(1, keepdims=True)
    p = [F.lit(1 / (model.distinct + 1)), *(F.col(f"p{i}").cast("double") for i in (1, 2, 3))]
    for _ in range(rounds):
        mixed = [F.element_at(F.array(*[F.lit(float(x)) for x in lam[:, i]]), F.col("class") + 1) * q for i, q in enumerate(p)]
        scale = F.col("n") / F.greatest(mixed[0] + mixed[1] + mixed[2] + mixed[3], F.lit(1e-300))
        new = lam.copy()
        for r in events.groupBy("class").agg(*[F.sum(x * scale) for x in mixed]).collect():  # at most classes ** 2 rows
            share = (np.array(r[1:]) + 0.5) * (lam[r[0]] > 0)  # a little of every estimate stays
            new[r[0]] = share / share.sum()
        moved, lam = np.abs(new - lam).max(), new
        if moved < near:
            break
    return lam


def score(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    s, spark = s or Settings(), docs.sparkSession
    chunked = chunks(docs, s)
    tokens = chunked.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    answered = answers(requests(chunked, max(1, -(-2 * tokens // s.bucket))))
    fit, held, distinct, fit_distinct, seen = answered.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("fit", "held_out", "distinct", "fit_distinct", "seen")]).first()
    known = (seen + 1) / (held + 2) if fit else 0.0
    # a text starts after as many ends as there are training documents
    ends = _ends(docs, s)
    events = held_out(chunked, answered, Model(fit, fit_distinct, known, ends[0], s.classes))
    model = Model(fit + held, distinct, known if fit + held else 0.0, sum(ends), s.classes)
    model.lam = weights(events, Model(fit, fit_distinct, known, ends[0], s.classes), s.rounds)
    remove(spark, events)
    sent = spark.sparkContext.broadcast(model)
    train_tokens = int(fit + held)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def kernel(c: Chunk, buckets, bodies) -> pa.Table:
        m = sent.value
        starts = c.starts()
        kind, parts, word = m.parts(c, _counts(c, buckets, bodies, False), starts)
        chance = m.lam[kind, 0] / (m.distinct + 1)
        for i, p in enumerate(parts):
            chance += m.lam[kind, i + 1] * p
        sums = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has a token
        base = sums(np.log10((word + 1) / (m.total + m.distinct + 1)))
        return pa.table([pa.array(c.ids, mask=c.null), pa.array(c.test), pa.array(c.count), pa.array(sums((word > 0).astype(np.int64))), pa.array(np.full(len(c.ids), train_tokens)), pa.array(base), pa.array(sums(np.log10(chance)))], names=names)

    return _met(chunked, answered, kernel, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _ends(docs: DataFrame, s: Settings) -> tuple[int, int]:
    """How many training documents are not held out, and are."""
    c = doc_crc(F.col("doc_id"))
    held = (c / 7).cast("long") % s.folds == 0
    got = docs.where(c % 7 != 2).agg(F.count(F.when(~held, 1)), F.count(F.when(held, 1))).first()
    return got[0], got[1]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
