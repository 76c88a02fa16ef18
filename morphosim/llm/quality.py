"""Document quality: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Statistics of a text (shares of letter kinds, word lengths, repetition) are
standardised and mapped to ``width`` cosines whose inner products approximate a
Gaussian kernel. Each partition sums its part of the normal equations; a fixed
number of tasks adds those up, and the driver solves one ``width`` x ``width``
system. A fifth of the training rows is left out of the fit; on it the score is
calibrated by pool-adjacent-violators over a histogram of bounded size.

Defined cases: null and empty texts have all-zero statistics and are scored like
others; a doc_id without label, or a null quality, isn't learned from; rows that
repeat a doc_id are scored (and learned from) each; without training rows of both
kinds every score is the training share of label 1, or 0.5 with no rows; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, doc_crc, remove, small_batches, table
from ._textkernel import Words, pieces, utf8

#: Kinds of bytes whose shares are statistics.
GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,", ";:'\"()-", "!?", "%$*&#@", "|/\\<>[]{}=+_^~`", "\n", " \t")
KIND = np.full(256, len(GROUPS), np.int64)
for _i, _g in enumerate(GROUPS):
    KIND[[ord(c) for c in _g]] = _i
N_KINDS = len(GROUPS) + 1
NAMES = [f"share_{i}" for i in range(N_KINDS)] + ["log_bytes", "log_words", "mean_length", "spread_length", "distinct", "repeats", "top_share", "short", "long", "odd_end", "capital"]


def statistics(words: Words) -> np.ndarray:
    """rows x statistics."""
    n, rows, data = np.diff(words.offsets), words.rows, words.data
    owner = np.repeat(np.arange(rows), n)
    out = np.zeros((rows, len(NAMES)))
    out[:, :N_KINDS] = np.bincount(owner * N_KINDS + KIND[data], minlength=rows * N_KINDS).reshape(rows, N_KINDS) / np.maximum(n, 1)[:, None]
    size, row, count = words.end - words.start, words.row, np.maximum(words.count, 1)
    per = lambda x: np.bincount(row, x, rows) / count
    mean = per(size)
    distinct, top = np.zeros(rows), np.zeros(rows)
    h = words.hash.copy()
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b > a:
            part = h[a:b]
            part.sort()
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            distinct[i], top[i] = (len(edges) - 1) / (b - a), np.diff(edges).max() / (b - a)
    again = np.zeros(len(row), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    last, first = (KIND[data[words.end - 1]], KIND[data[words.start]]) if len(row) else (row, row)
    out[:, N_KINDS:] = np.stack([np.log1p(n), np.log1p(words.count), mean, np.sqrt(np.maximum(per(size.astype(float) ** 2) - mean**2, 0)), distinct, per(again), top, per(size <= 3), per(size > 12), per((last >= 4) & (last <= 7)), per(first == 0)], 1)
    return out


def _statistics(column: pa.Array):
    """Ranges of rows and their statistics."""
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        yield a, b, statistics(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of ``text``."""

    def run(batches):
        for batch in batches:
            for a, b, x in _statistics(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "x"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


class Fourier:
    """Standardised statistics to ``width`` cosines and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, width: int = 384, scale: float = 3.0, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-12, spread, 1.0)
        self.w, self.b = rng.normal(0, 1 / scale, (len(mean), width)), rng.uniform(0, 2 * np.pi, width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.w + self.b
        return np.concatenate([np.sqrt(2 / z.shape[1]) * np.cos(z), np.ones((len(z), 1))], 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and never falling values. x ascending."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([b * c, c, a * c])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Classifier:
    """Fourier map, ridge weights and calibration."""

    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, centres: np.ndarray, values: np.ndarray):
        self.fourier, self.weights, self.centres, self.values = fourier, weights, centres, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.raw(x), self.centres, self.values), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def fit(rows: DataFrame, ridge: float = 1e-3, bins: int = 4096, width: int = 384) -> Classifier:
    """Learn from rows with x, y (0 or 1) and fold (0: calibrate, others: fit)."""
    sums = [F.avg(F.col("x")[i]) for i in range(len(NAMES))] + [F.stddev_pop(F.col("x")[i]) for i in range(len(NAMES))]
    n, share, *rest = rows.agg(F.count(F.lit(1)), F.avg(F.col("y").cast("double")), *sums).first()
    if not n or share in (0, 1):
        return Classifier(None, None, np.zeros(1), np.array([0.5 if not n else share]))
    mean, spread = np.array(rest[: len(NAMES)]), np.array(rest[len(NAMES) :])
    fourier = Fourier(mean, spread, width)

    def partial(batches):
        total = np.zeros((width + 1, width + 2))
        for batch in batches:
            z = fourier(_matrix(batch.column(0)))
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ batch.column(1).to_numpy().astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def added(batches):
        parts = [np.frombuffer(p, float) for batch in batches for p in batch.column(0).to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, 0).tobytes()], pa.binary())], ["total"])

    parts = rows.where("fold <> 0").select("x", "y").mapInArrow(partial, "total binary").repartition(4).mapInArrow(added, "total binary").collect()  # four matrices
    total = np.sum([np.frombuffer(p["total"], float) for p in parts], 0).reshape(width + 1, width + 2)
    a = total[:, :-1]
    weights = np.linalg.solve(a + ridge * np.trace(a) / len(a) * np.eye(len(a)), total[:, -1])
    model = Classifier(fourier, weights, np.zeros(1), np.zeros(1))

    def raw(batches):
        for batch in batches:
            at = np.clip((model.raw(_matrix(batch.column(0))) + 0.5) * bins / 2, 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "y"])

    got = rows.where("fold = 0").select("x", F.col("y").cast("int").alias("y")).mapInArrow(raw, "bin int, y int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()  # at most ``bins`` rows
    if not got:
        return Classifier(fourier, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    model.centres, model.values = isotonic(np.array([(r["bin"] + 0.5) * 2 / bins - 0.5 for r in got]), np.array([r["y"] for r in got]), np.array([float(r["n"]) for r in got]))
    return model


def _learnt(slim: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier from statistics (doc_id, x) and labels; rows with crc32(doc_id) mod 3 = 1 are never learned from."""
    crc = doc_crc(F.col("doc_id"))
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    train = slim.where(crc % 3 != 1).join(known, "doc_id").select("x", "y", ((crc / 3).cast("long") % 5).cast("int").alias("fold"))
    train = cut(train, "quality-train")
    model = fit(train)
    remove(slim.sparkSession, train)
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    slim = cut(with_statistics(docs), "statistics")
    model = slim.sparkSession.sparkContext.broadcast(_learnt(slim, labels))

    def run(batches):
        for batch in batches:
            s = model.value.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    found = slim.mapInArrow(run, "doc_id long, score double, predicted int")
    return found.select("doc_id", (doc_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", "predicted")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are predicted to be of quality 1.

    One Python worker takes each row's text once: statistics, score and choice are made in it.
    """
    spark = docs.sparkSession
    slim = cut(with_statistics(docs), "statistics")
    model, at = spark.sparkContext.broadcast(_learnt(slim, labels)), docs.columns.index("text")
    remove(spark, slim)

    def run(batches):
        for batch in batches:
            for a, b, x in _statistics(batch.column(at).cast(pa.string())):
                yield batch.slice(a, b - a).filter(pa.array(model.value.score(x) >= 0.5))

    small_batches(spark)
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
