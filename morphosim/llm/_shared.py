"""Shared storage and small helpers of the operators.

Lineage is cut with Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``: driver and executors all see it, so a lost executor
costs at most the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a session that runs on this machine alone gets one of its own, as in tests."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        name = f"file://{tempfile.mkdtemp(prefix='morphosim-')}"
        spark.conf.set("spark.checkpoint.dir", name)
    return name.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting to delete an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: an end of lineage that survives lost executors.

    ``rows``: at most so many short rows, which go into files of some 100,000, or eight.

    The shuffle files of the write are deleted with its end, as nothing reads them again;
    the setting that does it is the session's own again afterwards.
    """
    spark, schema = df.sparkSession, df.schema
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // 100_000)))
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by ``cut`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows per Arrow batch, for whole texts; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_crc(doc_id) -> "F.Column":
    """crc32 of an id written as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def buckets_for(rows: int, per_bucket: int = 20_000, least: int = 64) -> int:
    """How many hash buckets of about ``per_bucket`` rows to deal ``rows`` into."""
    return max(least, -(-rows // per_bucket))


def ranked(df: DataFrame, group: list[str], order: list[str], n_buckets: int, out: str) -> DataFrame:
    """Add ``out``: a gapless rank from 0 within ``group``, with no task that holds a whole group.

    Rows go into hash buckets of ``order``; a rank is the number of rows in the
    group's earlier buckets plus the place within the bucket.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    before = (
        df.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(W.partitionBy(*group).orderBy("_b")) - F.col("_n"))
        .drop("_n")
    )
    inside = df.withColumn("_r", F.row_number().over(W.partitionBy(*group, "_b").orderBy(*order)))
    return inside.join(before, [*group, "_b"]).withColumn(out, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_b", "_before", "_r")


LONG, DOUBLE, STRING, INT, BINARY = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.BinaryType()
