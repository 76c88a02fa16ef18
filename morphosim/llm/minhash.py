"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Documents with the same shingle set become one class (a 128-bit fingerprint
   of the set), so groups of copies shrink to a row before anything else.
2. Each class gets ``hashes`` minima; their low ``bits`` bits are packed into a
   signature, and runs of ``band_rows`` whole minima make band keys. With 128
   hashes in bands of 4, a pair at similarity 0.8 shares no band once in 10**7.
3. Classes that share a band are candidates. Instead of all pairs of a bucket,
   rounds compare each member with one hub of the bucket that is not yet in its
   component. Every bucket has a hub of its own, so members of a large group meet
   many hubs and soon are one component. What still lies apart then is compared in
   blocks, all against all, inside the tasks.
4. The estimated similarity, corrected for chance agreement of low bits, drops
   only pairs that are more than ``margin`` below the threshold (in the rounds, which
   decide nothing for good, already a little below it); the rest are confirmed
   exactly on the full sets.
5. Components join classes of confirmed links.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing, also not with each other; fewer words than a shingle make one shingle;
rows that repeat a doc_id share its component; a null doc_id is never a
component's smallest (a component of nulls only has a null id, and is kept);
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._shared import cut, small_batches, table
from ._textkernel import Words, as_long, mix, pieces, shingles, utf8

U64 = np.uint64


class Scheme:
    """Parameters of a search; ``shingle`` words, links at ``percent`` or more of Jaccard similarity."""

    def __init__(self, shingle: int = 5, percent: int = 80, hashes: int = 128, bits: int = 4, band_rows: int = 4, margin: float = 0.2, rounds: int = 2, block: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.shingle, self.percent, self.hashes, self.bits, self.band_rows, self.margin, self.rounds, self.block = shingle, percent, hashes, bits, band_rows, margin, rounds, block
        self.xor = rng.integers(0, 2**32, hashes, dtype=np.uint32)
        self.mul = rng.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def minima(self, sets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """hashes x rows, for rows that aren't empty."""
        x = ((sets ^ (sets >> U64(32))) & U64(0xFFFFFFFF)).astype(np.uint32)
        out = np.empty((self.hashes, len(first) - 1), np.uint32)
        for k in range(self.hashes):
            out[k] = np.minimum.reduceat((x ^ self.xor[k]) * self.mul[k], first[:-1])
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        """rows x bands of 64-bit keys, each telling its band too."""
        n = self.hashes // self.band_rows
        out = np.empty((minima.shape[1], n), U64)
        for k in range(n):
            key = np.full(minima.shape[1], k + 1, U64)
            for row in minima[k * self.band_rows : (k + 1) * self.band_rows]:
                key = mix(key * U64(0x9E3779B97F4A7C15) + row)
            out[:, k] = key
        return out

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """rows x words: the low bits of the minima."""
        each = 64 // self.bits
        low = (minima & np.uint32((1 << self.bits) - 1)).astype(U64).reshape(-1, each, minima.shape[1])
        return np.bitwise_or.reduce(low << (np.arange(each, dtype=U64) * U64(self.bits))[None, :, None], axis=1).T.copy()

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimated similarity from packed signatures: agreeing fields, less those that agree by chance."""
        x, shift = a ^ b, self.bits // 2
        while shift:
            x = x | (x >> U64(shift))
            shift //= 2
        ones = U64(sum(1 << i for i in range(0, 64, self.bits)))
        same = 1 - np.bitwise_count(x & ones).sum(-1) / self.hashes
        chance = 2.0**-self.bits
        return (same - chance) / (1 - chance)

    @property
    def least(self) -> float:
        return self.percent / 100 - self.margin

    @property
    def promising(self) -> float:
        return self.percent / 100 - self.margin / 4


def signatures(docs: DataFrame, s: Scheme) -> DataFrame:
    """doc_id, text_hash, n_shingles; for sets that aren't empty their fingerprint f1, f2, the packed signature and the band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in pieces(offsets):
                sets, first = shingles(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), s.shingle)
                n, prints = np.diff(first), []
                for salt in (U64(0x1234567), U64(0x7654321)):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets + salt), dtype=U64)])
                    prints.append(pa.array(as_long(mix(total[first[1:]] - total[first[:-1]])), mask=n == 0))
                full, k = np.flatnonzero(n), s.hashes // s.band_rows
                sig, size = np.full(b - a, None, object), np.zeros(b - a + 1, np.int32)
                size[full + 1] = k
                keys = np.zeros((0, k), U64)
                if len(full):
                    minima = s.minima(sets, np.concatenate([first[:-1][full], first[-1:]]))
                    keys = s.bands(minima)
                    sig[full] = [x.tobytes() for x in s.packed(minima)]
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), pa.array(as_long(keys.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), *prints, pa.array(sig, pa.binary()), bands], schema=schema)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, sig binary, bands array<long>")


def _likely(pairs: DataFrame, s: Scheme) -> DataFrame:
    """Pairs (a, sig_a, b, sig_b) whose estimate is promising."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    sig = lambda c: np.frombuffer(b"".join(c.to_pylist()), U64).reshape(len(c), -1)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(s.similarity(sig(batch.column(2)), sig(batch.column(3))) >= s.promising)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, s: Scheme, chunk: int = 64) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Pairs are dealt by their first member and a chunk of its partners, so a task
    holds one hub's set and those of at most some ``chunk`` partners at a time, and each
    text travels once for each chunk that it is in.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), (F.col("n") / F.lit(chunk)).cast("int") + 1)).cast("int"))
    need = dealt.select("a", "part", F.col("b").alias("node"), F.lit(False).alias("hub")).union(dealt.select("a", "part", F.col("a").alias("node"), F.lit(True).alias("hub")).distinct())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        a = group.column("a")[0].as_py()
        nodes, hubs = group.column("node").to_numpy(), group.column("hub").to_numpy(zero_copy_only=False)
        data, offsets = utf8(group.column("text").combine_chunks())
        sets, first = shingles(Words(data, offsets), s.shingle)
        i = int(np.flatnonzero(hubs)[0])
        own, found = sets[first[i] : first[i + 1]], []
        for j in np.flatnonzero(~hubs):
            other = sets[first[j] : first[j + 1]]
            both = np.intersect1d(own, other, assume_unique=True).size
            if 100 * both >= s.percent * (len(own) + len(other) - both):
                found.append(nodes[j])
        return pa.table([pa.array([a] * len(found), pa.int64()), pa.array(found, pa.int64())], schema=schema)

    return need.join(texts, "node").groupBy("a", "part").applyInArrow(run, "a long, b long")


def _link(classes: DataFrame, docs: DataFrame, s: Scheme) -> DataFrame:
    """node, root for the linked nodes of ``classes`` (node, doc_id, text_hash, sig, bands)."""
    members = classes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    n_classes = classes.count()
    members = cut(members.join(shared, "key", "left_semi"), "bands", n_classes * (s.hashes // s.band_rows))
    n_members = members.count()
    met = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash", "sig", "bands")
    slim = cut(met, "met", n_classes)
    texts = cut(_texts(slim, docs), "met-texts")
    if texts.count() > slim.count():  # rows that repeat id and text
        texts = cut(texts.groupBy("node").agg(F.first("text").alias("text")), "met-texts")
    links = roots = None

    def settle(pairs: DataFrame) -> None:
        nonlocal links, roots, members
        sig = lambda c: slim.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
        likely = cut(_likely(pairs.join(sig("a"), "a").join(sig("b"), "b"), s), "likely", n_members)  # a pair at most for each member and bucket
        found = cut(confirm(likely.join(likely.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a"), texts, s), "links")
        links = found if links is None else links.unionByName(found)
        roots = components(links, "a", "b")
        placed = members.select("node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        members = cut(placed.join(mixed, "key", "left_semi"), "mixed", n_members)

    for k in range(s.rounds):
        hub = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(k)).alias("o"), *members.drop("key").columns)).alias("h"))
        root = F.col("root") if roots is not None else F.col("node")
        hub_root = F.col("h.root") if roots is not None else F.col("h.node")
        apart = members.join(hub.select("key", F.col("h.node").alias("hub"), hub_root.alias("hub_root")), "key").where(root != F.col("hub_root"))
        settle(apart.select(F.col("hub").alias("a"), F.col("node").alias("b")).where("a <> b").distinct())
        if members.isEmpty():
            return roots
    found = cut(_blocks(members, slim, texts, s), "links")
    return components(links.unionByName(found), "a", "b")


def _texts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text for nodes (node, doc_id, text_hash); rows that repeat both id and text give one."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    nodes = nodes.select("node", "text_hash", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"))
    return docs.join(nodes, ["text_hash", "d"]).select("node", "text")


def _blocks(members: DataFrame, slim: DataFrame, texts: DataFrame, s: Scheme) -> DataFrame:
    """Confirmed links between members of a bucket that still lie in different components.

    Most members of a bucket are in its largest component by then. The others are
    dealt into blocks of queries, all members into blocks of targets. A task holds a
    block of each with their texts, confirms likely pairs itself and hands on only
    links, for each query one to a component. A pair is looked at in the first band
    that it shares.
    """
    by_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    total = by_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).select("key", F.col("top.root").alias("top"), (F.col("all") - F.col("top.n")).alias("few"), "all")
    placed = members.join(total, "key")
    count = lambda c: (F.col(c) / F.lit(s.block)).cast("int") + 1
    place = lambda c: F.pmod(F.xxhash64("node", F.lit(1)), count(c)).cast("int")
    queries = placed.where("root <> top").select("key", place("few").alias("q"), F.explode(F.sequence(F.lit(0), count("all") - 1)).alias("t"), "node", "root", F.lit(True).alias("asks"))
    targets = placed.select("key", F.explode(F.sequence(F.lit(0), count("few") - 1)).alias("q"), place("all").alias("t"), "node", "root", F.lit(False).alias("asks"))
    rows = queries.union(targets).join(slim.select("node", "sig", "bands"), "node").join(texts, "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        key, asks = group.column("key")[0].as_py(), group.column("asks").to_numpy(zero_copy_only=False)
        node, root = group.column("node").to_numpy(), group.column("root").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), U64).reshape(len(node), -1)
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        band = int(np.flatnonzero(bands[0] == key)[0])
        data, offsets = utf8(group.column("text").combine_chunks())
        sets, first = shingles(Words(data, offsets), s.shingle)
        size, there, out = np.diff(first), np.flatnonzero(~asks), []
        for i in np.flatnonzero(asks):
            small, large = np.minimum(size[i], size[there]), np.maximum(size[i], size[there])
            near = there[(root[there] != root[i]) & (100 * small >= s.percent * large)]
            near = near[~(bands[near, :band] == bands[i, :band]).any(1)]
            alike = s.similarity(sig[i], sig[near])
            linked: set[int] = set()
            for j in near[np.argsort(-alike, kind="stable")][: int((alike >= s.least).sum())]:
                if root[j] not in linked:
                    both = np.intersect1d(sets[first[i] : first[i + 1]], sets[first[j] : first[j + 1]], assume_unique=True).size
                    if 100 * both >= s.percent * (size[i] + size[j] - both):
                        linked.add(root[j])
                        out.append((node[i], node[j]))
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)

    return rows.groupBy("key", "q", "t").applyInArrow(run, "a long, b long")


def grouped(docs: DataFrame, s: Scheme) -> DataFrame:
    """doc_id, text_hash, n_shingles, root, component_id for each row of ``docs`` (doc_id, text); the root, of its component, is null without shingles."""
    rows = cut(signatures(docs, s), "signatures")
    full = rows.where("f1 is not null")
    # a class goes by its least id, a null one behind all others; its rows share signature and bands
    least = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("m")
    classes = full.groupBy("f1", "f2").agg(least, F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = cut(classes.select(F.col("f1").alias("node"), "f2", F.col("m.doc_id").alias("doc_id"), F.col("m.text_hash").alias("text_hash"), "sig", "bands"), "classes", rows.count())
    named = classes.select("node", "f2", "doc_id").join(_link(classes, docs, s), "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = named.join(by_root, "root").select(F.col("node").alias("f1"), "f2", "root", "component_id")
    linked = full.select("f1", "f2", "doc_id", "text_hash", "n_shingles").join(by_class, ["f1", "f2"]).select("doc_id", "text_hash", "n_shingles", "root", "component_id")
    empty = rows.where("f1 is null").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return linked.union(empty)


def near_duplicates(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    found = grouped(docs, scheme or Scheme()).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def superfluous(docs: DataFrame, s: Scheme) -> DataFrame:
    """doc_id, text_hash of the rows of each component but one: that with its smallest id (a null one is behind all others) and then text hash."""
    rows = cut(grouped(docs, s).where("root is not null").select("root", "doc_id", "text_hash").distinct(), "grouped")
    one = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("m"))
    other = ~F.col("doc_id").eqNullSafe(F.col("m.doc_id")) | (F.col("text_hash") != F.col("m.text_hash"))
    return rows.join(one, "root").where(other).select("doc_id", "text_hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scheme(shingle=4))
