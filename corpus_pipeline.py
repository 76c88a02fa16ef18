"""A corpus pipeline: each stage works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the cluster's shared folder and rereads it as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphosim.llm import decontaminate, minhash, packing, quality, secretscan
from morphosim.llm._shared import cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1. Labels of all rows but a held-out third are learned from."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (words in fives, similarity 0.8 or more) the document with the smallest id.

    Rows go by id and text, so null and repeated ids take no other row with them. Of
    rows that repeat both one stays; of rows without words only those that are equal go.
    """
    gone = minhash.superfluous(docs, minhash.Scheme(shingle=5)).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash"))
    kept = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_hash"]), "left_anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    return kept.withColumn("_rest", F.when(blank, F.struct(F.lit(0), *others))).dropDuplicates(["doc_id", "text", "_rest"]).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span replaced and ``n_chars`` counted anew where the text changed."""
    return secretscan.redact(docs, secretscan.train(docs), count="n_chars")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.query(spark, sf_dir, docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("best-fit packing", sequences),
]
#: No stage but the third can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
