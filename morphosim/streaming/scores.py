"""New clouds from a stream against a fixed set: stateless, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.bins import ScoreTable
from ..operators.neighbours import raw_scores
from ..operators.scoring import product


def score_stream(arriving: DataFrame, known: DataFrame, table: ScoreTable, path: str, checkpoint: str, use_alpha: bool = False) -> StreamingQuery:
    """Score each micro-batch's whole clouds (dotprops) against all ``known`` ones, and append the scores to ``path``.

    A batch writes a folder of its own number, so one that is run again replaces its first attempt.
    """

    def batch(df: DataFrame, number: int) -> None:
        shifted = known.withColumn("cloud_id", -1 - F.col("cloud_id"))  # ids of both sides may clash
        pairs = product(df, shifted)
        got = raw_scores(df.unionByName(shifted), pairs, table, use_alpha).withColumn("target_id", -1 - F.col("target_id"))
        got.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
