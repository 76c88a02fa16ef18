"""Best-two-fit packing of tokenised documents into sequences.

Lengths are whole numbers up to the capacity, so the packing is planned on the
histogram of lengths: at most ``capacity`` entries, however many documents there
are. Each planned pattern is used as often as the counts allow, which uses up a
length each time, so the plan too is bounded by the capacity.

Planning one pattern: fill greedily with the largest length that fits, until none
does; then take out the smallest document and look for two unpacked ones that
fit the widened gap more tightly, and repeat until none does. Documents get their
place by their gapless rank among those of equal length.

Defined cases: a null or blank text is the end token alone; a null doc_id is kept
as null; repeated rows are packed as often as they occur; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pieces import encoder
from ._shared import buckets_for, cut, ranked, small_batches, table

CAPACITY, END_ID = 4096, 1

def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 (and ids as little-endian bytes)."""
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema, end, step = pa.schema(kinds), np.array([END_ID], "<u4"), capacity

    def cutter(batches):
        words = encoder(tokenizer)
        for batch in batches:
            for a in range(0, batch.num_rows, 250):
                rows = []
                for doc, ids in zip(batch.column(0)[a : a + 250].to_pylist(), words.encode(batch.column(1)[a : a + 250]), strict=True):
                    ids = np.concatenate([ids.astype("<u4"), end])
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step].tobytes()
                        rows.append((doc, k, at, len(part) // 4, zlib.crc32(part)) + (part,) * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cutter, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in one sequence, how many sequences) that use up ``counts``, by best-two-fit."""
    left = {k: v for k, v in counts.items() if v}
    sizes = sorted(left)
    out = []

    def fits(gap: int, used: dict[int, int]) -> int:
        i = bisect.bisect_right(sizes, gap) - 1
        while i >= 0 and left[sizes[i]] <= used.get(sizes[i], 0):
            i -= 1
        return sizes[i] if i >= 0 else 0

    def two(gap: int, above: int, used: dict[int, int]) -> tuple[int, int] | None:
        """Two unpacked lengths of at most ``gap`` together, with the largest sum over ``above``."""
        have = [x for x in sizes[: bisect.bisect_right(sizes, gap)] if left[x] > used.get(x, 0)]
        best, found, i, j = above, None, 0, len(have) - 1
        while i <= j:
            total = have[i] + have[j]
            if total > gap or i == j and left[have[i]] - used.get(have[i], 0) < 2:
                j -= 1
                continue
            if total > best:
                best, found = total, (have[j], have[i])
            i += 1
        return found

    while sizes:
        used: dict[int, int] = {}
        gap, bin_ = capacity, []

        def put(x: int) -> None:
            used[x] = used.get(x, 0) + 1
            bisect.insort(bin_, x)

        while x := fits(gap, used):
            put(x)
            gap -= x
        while gap and len(bin_) > 1:
            x = bin_[0]
            used[x] -= 1
            pair = two(gap + x, x, used)
            if not pair:
                used[x] += 1
                break
            bin_.pop(0)
            for y in pair:
                put(y)
            gap += x - sum(pair)
        times = min(left[x] // n for x, n in used.items() if n)
        out.append((bin_[::-1], times))
        for x, n in used.items():
            if n:
                left[x] -= n * times
                if not left[x]:
                    del left[x]
                    sizes.pop(bisect.bisect_left(sizes, x))
    return out


def places(patterns: list[tuple[list[int], int]]) -> dict[int, list[np.ndarray]]:
    """For each length: from which rank a pattern's slot starts, its first sequence and offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.setdefault(x, []).append((seen.get(x, 0), base, offset))
            seen[x] = seen.get(x, 0) + times
            offset += x
        base += times
    return {x: [np.array(c, np.int64) for c in zip(*r, strict=True)] for x, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with columns doc_id, piece and length."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    where = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    at = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32", "start"], buckets_for(sum(counts.values())), "rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema if f.name != "rank")

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                first, base, off = where.value[int(x)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = base[k] + rank[mine] - first[k], off[k]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    return at.mapInArrow(place, kinds + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    from public_tokenizers import path

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return pack(cut(tokenized(docs, path("word_bpe_49k.json")), "pieces"))
