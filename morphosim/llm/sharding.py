"""Balanced label propagation: linked documents move towards their neighbours' shards, under capacity quotas.

Documents start in shards by hash. In each round every linked document finds the
shard where most of its neighbours are; of those that would gain, as many bytes may
move between two shards as keep both within capacity. Only sums by shard pair, gain
and hash bin leave the executors, and the driver turns them into one cut for each
pair: a table of bounded size. The round's moves are the documents below their cut.

At the end, documents without links fill what the linked ones have left of each
shard. The largest ones (a bounded number) go one by one where most room is; the
others lie on a line by hash and are cut at the shards' remaining shares. So sizes
differ by little more than a small document, and links between shards stay few.

Law ``bytes``: sizes near equal. Links of the query: equal texts, each to the one with the
smallest id, so a group of n has n - 1 links.

Defined cases: null text has size 1; a null doc_id is kept; repeated rows are placed
each; an empty table gives no rows; extra columns are ignored. Documents are told
apart by (doc_id, text, place among equal ones).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import buckets_for, cut, ranked, remove, table

BINS = 64


def _quotas(wish: dict[tuple[int, int], np.ndarray], room: np.ndarray, give: np.ndarray) -> dict[tuple[int, int], int]:
    """For each (from, to) the number of bins whose bytes may move.

    wish: bytes by bin, best gain first. Opposite moves of equal size always fit;
    what goes beyond is bounded by ``room`` of the target.
    """
    room = room.astype(float).copy()
    total = {p: w.sum() for p, w in wish.items()}
    allow = {p: min(total[p], total.get(p[::-1], 0.0)) for p in wish}
    for p in sorted(wish, key=lambda p: -(total[p] - allow[p])):
        more = min(total[p] - allow[p], max(room[p[1]], 0.0))
        allow[p] += more
        room[p[1]] -= more
        room[p[0]] += more
    out = {}
    for p, w in wish.items():
        out[p] = int(np.searchsorted(np.cumsum(w), allow[p] + 1e-9, "right"))
    return out


def propagate(nodes: DataFrame, links: DataFrame, shards: int, capacity: float, rounds: int = 4) -> DataFrame:
    """node, size, shard of linked nodes (node, size) after ``rounds``; links (a, b) are between nodes.

    A round joins the links with both ends' shards; a node with very many links is on
    the many side of a join with unique rows, so it can be split, and its neighbours
    are counted by shard before they are dealt out.
    """
    spark = nodes.sparkSession
    state = cut(nodes.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(shards)).cast("int")), "shards")
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    for k in range(rounds):
        there = both.join(state.select(F.col("node").alias("b"), "shard"), "b").groupBy("a", "shard").count()
        best = there.groupBy("a").agg(F.max(F.struct("count", F.xxhash64("shard", F.lit(k)).alias("h"), "shard")).alias("m"), F.map_from_entries(F.collect_list(F.struct("shard", "count"))).alias("at"))
        moving = state.join(best.select(F.col("a").alias("node"), F.col("m.shard").alias("to"), F.col("m.count").alias("top"), "at"), "node", "left")
        gain = F.col("top") - F.coalesce(F.try_element_at("at", F.col("shard")), F.lit(0))
        # moves go down in one round and up in the next, so that neighbours don't swap places
        turn = F.col("to") < F.col("shard") if k % 2 == 0 else F.col("to") > F.col("shard")
        grade = F.greatest(F.lit(0), 7 - F.floor(F.log2(gain.cast("double")))).cast("int")
        bin_ = (grade * F.lit(BINS) + F.pmod(F.xxhash64("node", F.lit(k)), F.lit(BINS))).cast("int")
        moving = cut(moving.withColumn("bin", F.when((gain > 0) & turn, bin_)).select("node", "size", "shard", "to", "bin"), "wishes")
        sizes = np.zeros(shards)
        for r in moving.groupBy("shard").agg(F.sum("size").alias("n")).collect():
            sizes[r["shard"]] = r["n"]
        wish: dict[tuple[int, int], np.ndarray] = {}
        for r in moving.where("bin is not null").groupBy("shard", "to", "bin").agg(F.sum("size").alias("n")).collect():  # at most shards ** 2 * 8 * BINS rows
            wish.setdefault((r["shard"], r["to"]), np.zeros(8 * BINS))[r["bin"]] = r["n"]
        cuts = _quotas(wish, capacity - sizes, sizes)
        below = spark.createDataFrame([(*p, n) for p, n in cuts.items()] or [(-1, -1, 0)], "shard int, to int, cut int")
        new = moving.join(F.broadcast(below), ["shard", "to"], "left").select("node", "size", F.when(F.col("bin") < F.col("cut"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        new = cut(new, "shards")
        remove(spark, state)
        remove(spark, moving)
        state = new
    return state


def _fill(free: DataFrame, shares: np.ndarray, rows: int, big: float) -> DataFrame:
    """node, size, shard: free nodes fill ``shares`` (bytes each shard still lacks)."""
    spark = free.sparkSession
    shares = np.maximum(shares, 0.0)
    large = free.where(F.col("size") > big).select("node", "size").orderBy(F.desc("size"), "node").collect()  # fewer than the whole's bytes / big
    placed = []
    for r in large:
        s = int(np.argmax(shares))
        shares[s] -= r["size"]
        placed.append((r["node"], s))
    shares = np.maximum(shares, 0.0)
    small = free.where(F.col("size") <= big).withColumn("_b", F.pmod(F.xxhash64("node", F.lit(9)), F.lit(buckets_for(rows))).cast("int"))
    # the whole line stretches over all shares
    sums = small.groupBy("_b").agg(F.sum("size").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("_b")) - F.col("n"))
    total = small.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bounds = (np.cumsum(shares) / max(shares.sum(), 1e-9) * total).tolist()
    line = small.withColumn("in", F.sum("size").over(W.partitionBy("_b").orderBy("node").rowsBetween(W.unboundedPreceding, 0))).join(sums.select("_b", "before"), "_b")
    middle = F.col("before") + F.col("in") - F.col("size") / 2
    shard = F.least(F.lit(len(shares) - 1), F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < middle)))
    there = line.select("node", "size", shard.cast("int").alias("shard"))
    if placed:
        known = spark.createDataFrame(placed, "node long, shard int")
        there = there.unionByName(free.join(F.broadcast(known), "node").select("node", "size", "shard"))
    return there


def assign(docs: DataFrame, shards: int = 16, rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.sha2(text, 256).alias("text_key"), F.monotonically_increasing_id().alias("node"),
    )
    rows = cut(base, "sizes")
    groups = rows.groupBy("text_key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n"))
    member = rows.join(groups.where("n > 1"), "text_key").select("node", "size", "hub")
    member = cut(member, "members")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    linked = propagate(member.select("node", "size"), member.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")), shards, total / shards, rounds)
    used = np.zeros(shards)
    for r in linked.groupBy("shard").agg(F.sum("size").alias("n")).collect():
        used[r["shard"]] = r["n"]
    free = rows.join(linked.select("node"), "node", "left_anti").select("node", "size")
    # documents above this are fewer than shards * 256
    filled = _fill(free, total / shards - used, n, total / shards / 256)
    where = cut(linked.select("node", "shard").unionByName(filled.select("node", "shard")), "placed")
    placed = rows.join(where, "node").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "node")
    return ranked(placed, ["shard"], ["node"], buckets_for(n // shards), "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
