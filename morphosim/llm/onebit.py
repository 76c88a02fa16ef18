"""Nearest neighbours by inner product, over randomly rotated one-bit codes.

Vectors are centred, scaled to length 1, rotated by a random orthogonal matrix and
kept as the signs of their coordinates, packed into bytes, with two scalars: the
length and the inner product of the code with the vector. From them and a query
comes an unbiased estimate of the inner product and a bound on its error that holds
with high probability. The most promising of a block are measured exactly, and then all
whose upper bound reaches the k-th best of these; the others cannot be among the nearest.

Equal vectors are one entry of the index, with the k + 1 smallest ids of those that
share it: more can't be told apart by score and never come first. Queries and
entries meet block by block, so a task's memory is a block of each.

Defined cases: vectors that are null, empty, all zero, of another length than most
(ties: the shorter), or that hold null or non-finite components take no part, nor do
rows without id; rows that repeat id and vector count once; an id with several vectors
asks with the first of them, by components, and is found by each; fewer than k candidates
give them all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import cut, table


def rotation(dim: int, seed: int = 29) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


class Coder:
    """Codes and scalars of vectors, and estimates with bounds for queries."""

    def __init__(self, centre: np.ndarray, epsilon: float = 3.0, seed: int = 29):
        self.centre, self.epsilon, self.turn = centre, epsilon, rotation(len(centre), seed)
        self.dim = len(centre)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, lengths, and the inner product of each unit vector with its code."""
        y = (x - self.centre) @ self.turn.T
        length = np.linalg.norm(y, axis=1)
        own = np.abs(y).sum(1) / np.sqrt(self.dim) / np.where(length > 0, length, 1)
        return np.packbits(y > 0, axis=1), length, np.where(length > 0, own, 1.0)

    def signs(self, codes: np.ndarray) -> np.ndarray:
        """Packed signs as -1 and 1, vectors x coordinates."""
        return np.unpackbits(codes, axis=1)[:, : self.dim].astype(np.float32) * 2 - 1

    def estimate(self, q: np.ndarray, signs: np.ndarray, length: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries x vectors) and their bounds."""
        total = (q @ self.turn.T / np.sqrt(self.dim)).astype(np.float32) @ signs.T
        off = self.epsilon * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(self.dim - 1, 1)) * length
        size = np.linalg.norm(q, axis=1)
        return total * (length / own) + (q @ self.centre)[:, None], size[:, None] * (off + 1e-5 * (length + np.linalg.norm(self.centre)))[None, :]


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v: rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite)
    most = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return some.where(F.size("v") == (most["n"] if most else 0))


def entries(some: DataFrame, k: int) -> DataFrame:
    """ids (at most k + 1, ascending) and v of each distinct vector."""
    keyed = some.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    ids = keyed.select("h1", "h2", "vec_id").distinct()
    few = ids.withColumn("r", F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= k + 1)  # limited before it is dealt out
    lists = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    least = lists.select("h1", "h2", "ids", F.col("ids")[0].alias("vec_id"))
    return least.join(keyed.dropDuplicates(["h1", "h2", "vec_id"]), ["h1", "h2", "vec_id"]).select("ids", "v")


def encoded(index: DataFrame, coder: Coder) -> DataFrame:
    """``index`` with its codes and scalars."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, coder.dim))
            codes, length, own = coder.encode(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(own)], ["ids", "v", "code", "length", "own"])

    return index.mapInArrow(run, "ids array<long>, v array<double>, code binary, length double, own double")


def search(index: DataFrame, queries: DataFrame, coder: Coder, k: int, entry_block: int = 16384, query_block: int = 8192, step: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each of ``queries`` (vec_id, v)."""
    n, q = max(1, -(-index.count() // entry_block)), max(1, -(-queries.count() // query_block))
    left = index.withColumn("e", F.pmod(F.xxhash64("ids"), F.lit(n))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    right = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(q)).cast("int")).withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("e", F.col("e").cast("long"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy()
        x, y = flat(a, "v").reshape(a.num_rows, -1), flat(b, "v").reshape(b.num_rows, -1)
        signs = coder.signs(np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8).reshape(a.num_rows, -1))
        length, own = a.column("length").to_numpy(), a.column("own").to_numpy()
        ids, sizes = flat(a, "ids"), a.column("ids").combine_chunks().value_lengths().to_numpy()
        first, names, out = np.concatenate([[0], np.cumsum(sizes)]), b.column("vec_id").to_numpy(), []
        need = min(k + 1, a.num_rows)
        few = min(4 * need, a.num_rows)
        for at in range(0, len(y), step):
            part = y[at : at + step]
            mean, off = coder.estimate(part, signs, length, own)
            # the need-th best of the most promising bounds what must be looked at
            top = np.argpartition(-mean, few - 1, axis=1)[:, :few]
            exact = np.einsum("qfd,qd->qf", x[top], part)
            floor = np.partition(exact, few - need, axis=1)[:, few - need]
            floor -= 1e-12 * np.abs(floor)
            rows, entry = np.nonzero(mean + off >= floor[:, None])
            score = np.concatenate([np.einsum("nd,nd->n", x[entry[i : i + 65536]], part[rows[i : i + 65536]]) for i in range(0, len(rows), 65536)])
            near = score >= floor[rows]  # all of the nearest, and ties with the last
            rows, entry, score = rows[near], entry[near], score[near]
            n_ids = sizes[entry]
            which = np.repeat(first[entry] - (np.cumsum(n_ids) - n_ids), n_ids) + np.arange(n_ids.sum())
            rows, name, score = np.repeat(rows, n_ids), ids[which], np.repeat(score, n_ids)
            other = name != names[at + rows]
            rows, name, score = rows[other], name[other], score[other]
            order = np.lexsort((name, -score, rows))
            rows, name, score = rows[order], name[order], score[order]
            best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            out.append(pa.table([names[at + rows[best]], name[best], score[best]], schema=schema))
        return pa.concat_tables(out)

    met = left.groupBy("e", "q").cogroup(right.groupBy("e", F.col("q"))).applyInArrow(lambda a, b: run(a, b), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest of each vector whose id is divisible by ``every``, among all others."""
    spark = vectors.sparkSession
    some = valid(vectors)
    index = cut(entries(some, k), "index")
    dim = index.select(F.max(F.size("v"))).first()[0] or 1
    centre = index.agg(*[F.avg(F.col("v")[i]) for i in range(dim)]).first()
    coder = Coder(np.array([c or 0.0 for c in centre]))
    queries = cut(some.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    return search(cut(encoded(index, coder), "codes"), queries, coder, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
