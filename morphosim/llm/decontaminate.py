"""Benchmark decontamination by a prefix-filtered set join, in DataFrame expressions alone.

A window is 13 consecutive words of an item (all of a shorter one), as a set join sees
it the set of its shingles: runs of ``SHINGLE`` words, or the whole of a shorter
window. It occurs in a document only with all its shingles, so one is prefix enough:
the rarest, counted over the documents. Documents' shingles are joined with those
prefix shingles only. A shingle's place in the window gives the place where the window
would start; it must lie within the document (the positional and length bounds). The
words that stand there must have the window's hash, and are then compared with the
window's own, word by word.

Texts are read for the rarity of the benchmark's shingles, for the candidates, and once
more for the number of words. Tables of fixed width
are broadcast up to ``BROADCAST`` rows, some ten MB; beyond that they are joined by
shuffle, and shingles are counted before they are dealt out. Equal texts are one from
the candidates on.

Defined cases: a null text has no words; an item without words has no window; equal
texts, and repeated rows and items, are each reported; a null doc_id is kept, a null
item_id counts as an item but not in the digest; empty tables give no hits or no
rows; very long texts are searched whole; other columns stay as they are, but those with
the names of the results, which these replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, table

WINDOW, SHINGLE = 13, 3
#: Rows of a table of at most four numbers that may be broadcast: some ten MB.
BROADCAST = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def lowered(text: Column) -> Column:
    """A-Z in lower case; the general function does the same, faster, for ASCII texts."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(lowered(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """item, words: each window of each item."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")).distinct()


def shingled(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` (with words ``w``), and pos and s: each place and the hash of the shingle of each of ``sizes`` there."""
    some = rows.where(F.size("w") >= min(sizes)).select("*", F.explode(F.sequence(F.lit(0), F.size("w") - min(sizes))).alias("pos"))
    hashed = [F.xxhash64(F.lit(k), *[F.get("w", F.col("pos") + i) for i in range(k)]) for k in sizes]
    if len(sizes) == 1:
        return some.withColumn("s", hashed[0])
    fits = [F.when(F.col("pos") + k <= F.size("w"), h) for k, h in zip(sizes, hashed, strict=True)]
    return some.withColumn("s", F.explode(F.array(*fits))).where("s is not null")


def prefixes(texts: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """s, offset, size, window: each distinct window (words) under its rarest shingle."""
    own = F.least(F.size("words"), F.lit(SHINGLE))
    each = shingled(windows.select("words", F.col("words").alias("w")), sizes)
    # a window's shingles have one size
    each = cut(each.where(F.col("s") == F.element_at(F.array(*[F.xxhash64(F.lit(k), *[F.get("w", F.col("pos") + i) for i in range(k)]) for k in range(1, SHINGLE + 1)]), own)).select("words", F.col("pos").alias("offset"), "s"), "shingles")
    wanted = cut(each.select("s").distinct(), "wanted")
    met = shingled(texts.select(words_of(F.col("text")).alias("w")), sizes).select("s")
    if wanted.count() <= BROADCAST:
        rarity = met.join(F.broadcast(wanted), "s", "left_semi").groupBy("s").count()
    else:
        rarity = met.groupBy("s").count().join(wanted, "s", "left_semi")
    least = each.join(rarity, "s", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "s", "offset")).alias("m"))
    return least.select(F.col("m.s").alias("s"), F.col("m.offset").alias("offset"), F.size("words").alias("size"), F.xxhash64("words").alias("window"))


def occurrences(texts: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """key, start, words: where each window stands in each distinct text (text)."""
    prefix = cut(prefixes(texts, windows, sizes), "prefixes")
    small = prefix.count() <= BROADCAST
    cut_up = texts.select(text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("w"))
    if small:
        met = shingled(cut_up, sizes).join(F.broadcast(prefix), "s").withColumn("n", F.size("w"))
    else:  # a text's words don't travel with each of its shingles
        met = shingled(cut_up, sizes).select("key", F.size("w").alias("n"), "pos", "s").join(prefix, "s")
    start = F.col("pos") - F.col("offset")
    met = met.withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    if not small:
        met = met.select("key", "start", "size", "window").distinct().join(cut_up.dropDuplicates(["key"]), "key")
    place = F.slice("w", F.greatest(F.col("start") + 1, F.lit(1)), F.col("size"))  # conditions may be asked in any order
    found = met.where(F.xxhash64(place) == F.col("window")).select("key", "start", "window", place.alias("words")).distinct()
    return found.join(windows.select("words", F.xxhash64("words").alias("window")), ["window", "words"], "left_semi").select("key", "start", "words")


def found(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """key, n_hit, n_items, items_sha256 of each distinct text of ``docs`` (text) in which a window stands."""
    flat = cut(windows_of(items, size), "windows")
    windows = flat.select("words").distinct()
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).distinct().collect())  # at most SHINGLE rows
    if not sizes:
        none = docs.limit(0).select(text_key(F.col("text")).alias("key"))
        return none.select("key", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items_sha256"))
    at = cut(occurrences(docs.select("text"), windows, sizes), "occurrences")
    # the length of the union of a text's intervals, taken in order of their starts
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.size("words")).alias("stop"))))
    union = F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["to"], x["start"]))).alias("n"), F.greatest(a["to"], x["stop"]).alias("to")), lambda a: a["n"].cast("long"),
    )
    hit = at.groupBy("key").agg(union.alias("n_hit"))
    met = at.select("key", "words").distinct().join(flat, "words").select("key", "item").distinct()
    ids = F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256)  # a null id isn't collected
    return hit.join(met.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), ids.alias("items_sha256")), "key")


def _judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (row, key, n_words) and the other results."""
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(found, "key", "left").select(
        "row", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated"),
    )


def _rows(docs: DataFrame, kept: list[str]) -> DataFrame:
    """row (the columns ``kept`` as one), key, n_words."""
    count = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SEPARATORS), "")).cast("long")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text_key(F.col("text")).alias("key"), count.alias("n_words"))


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, kept: list[str] | None = None) -> DataFrame:
    """The columns ``kept`` of ``docs`` (all of them, if not given) and n_words, n_hit, n_items, items_sha256, contaminated."""
    kept = [c for c in (docs.columns if kept is None else kept) if c not in RESULTS]
    return _judged(_rows(docs, kept), found(docs, items, size)).select(*[F.col("row")[c].alias(c) for c in kept], *RESULTS)


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that aren't contaminated. Only texts with hits are judged; the others don't move for them."""
    hit = cut(found(docs, items, size), "hit-texts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(F.col("text")).alias("key"))
    some = docs.select(F.col("text").alias("text"), text_key(F.col("text")).alias("key")).join(hit, "key", "left_semi").dropDuplicates(["key"])
    bad = _judged(_rows(some, ["text"]), hit).where("contaminated").select(text_key(F.col("row.text")).alias("key"))
    return rows.join(cut(bad, "contaminated"), "key", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), kept=["doc_id"])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 12)::BIGINT + 1), lambda k: w[k:k + 12])) AS g FROM b WHERE len(w) > 0),
p AS (SELECT row, len(w) AS n, w, unnest(range(1, len(w) + 1)) AS k FROM d),
s AS (SELECT DISTINCT len(g) AS size FROM i),
h AS (SELECT p.row, p.k, i.item_id, s.size FROM p JOIN s ON p.k + s.size - 1 <= p.n JOIN i ON len(i.g) = s.size AND array_to_string(i.g, ' ') = array_to_string(p.w[p.k:p.k + s.size - 1], ' ')),
c AS (SELECT row, count(DISTINCT x) AS n_hit FROM (SELECT row, unnest(range(k, k + size)) AS x FROM h) GROUP BY row),
m AS (SELECT row, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM h GROUP BY row)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, coalesce(m.items_sha256, sha256('')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN m USING (row)
"""
