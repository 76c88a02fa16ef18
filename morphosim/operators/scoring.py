"""Raw, normalised and symmetric similarity scores of pairs of clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import ScoreTable
from ..functions.vectors import centroids, combine, distance
from .neighbours import raw_scores

NAN = float("nan")


def self_hits(clouds: DataFrame, table: ScoreTable, use_alpha: bool = False) -> DataFrame:
    """cloud_id, n_points, cx, cy, cz, self_hit: a cloud against itself matches every point at distance 0. An alpha of NaN counts as 0."""
    base = centroids(clouds)
    if not use_alpha:
        return base.withColumn("self_hit", F.col("n_points") * table.score(F.lit(0.0), F.lit(1.0)))
    return base.join(clouds.groupBy("cloud_id").agg(F.sum(table.score(F.lit(0.0), F.nanvl("alpha", F.lit(0.0)))).alias("self_hit")), "cloud_id")


def product(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """All pairs of ids of two ``cloud_id`` tables; the result is the request, of that size by nature."""
    q = queries.select(F.col("cloud_id").alias("query_id")).distinct()
    return q.crossJoin(targets.select(F.col("cloud_id").alias("target_id")).distinct())


def within(pairs: DataFrame, summary: DataFrame, most: float, compat: bool = False) -> DataFrame:
    """``pairs`` and ``near``: whether the centroids are closer than ``most``; a cloud always is to itself.

    ``compat``: the distance is the root of both centroids' summed squares, as in a
    published implementation that grows with the distance from the origin.
    """
    side = lambda p: summary.select(F.col("cloud_id").alias(f"{p}_id"), *[F.col(f"c{c}").alias(f"{p[0]}{c}") for c in "xyz"])
    a, b = [F.col(f"q{c}") for c in "xyz"], [F.col(f"t{c}") for c in "xyz"]
    d = F.sqrt(sum(x * x + y * y for x, y in zip(a, b, strict=True))) if compat else distance(*a, *b)
    near = (F.col("query_id") == F.col("target_id")) | (d < most)
    return pairs.join(side("query"), "query_id").join(side("target"), "target_id").select("query_id", "target_id", near.alias("near"))


def scores(
    clouds: DataFrame, pairs: DataFrame, table: ScoreTable, use_alpha: bool = False, normalize: bool = False, symmetry: str | None = None,
    max_centroid_dist: float | None = None, compat_centroids: bool = False, summary: DataFrame | None = None,
) -> DataFrame:
    """query_id, target_id, score: one row for each distinct pair of known ids.

    A pair of a cloud with itself is its self-hit, or exactly 1 if normalised. Each
    direction is divided by its own query's self-hit, then both are combined. Pairs
    whose centroids are too far apart are NaN and cost no search.
    """
    known = clouds.select("cloud_id").distinct() if summary is None else summary.select("cloud_id")
    summary = self_hits(clouds, table, use_alpha) if summary is None else summary
    pairs = pairs.select("query_id", "target_id").distinct()
    if max_centroid_dist is None:
        ids = lambda c: known.select(F.col("cloud_id").alias(c))
        pairs = pairs.join(ids("query_id"), "query_id", "left_semi").join(ids("target_id"), "target_id", "left_semi").withColumn("near", F.lit(True))
    else:
        pairs = within(pairs, summary, max_centroid_dist, compat_centroids)
    wanted = pairs.where("near AND query_id <> target_id").select("query_id", "target_id")
    if symmetry is not None:
        wanted = wanted.select(F.explode(F.array(F.struct("query_id", "target_id"), F.struct(F.col("target_id").alias("query_id"), F.col("query_id").alias("target_id")))).alias("p")).select("p.*").distinct()
    raw = raw_scores(clouds, wanted, table, use_alpha)
    hits = summary.select(F.col("cloud_id").alias("query_id"), "self_hit")
    if symmetry is not None:
        # both directions of a pair come together, each over its own query's self-hit
        if normalize:
            raw = _over(raw.join(hits, "query_id"))
        both = raw.groupBy(F.least("query_id", "target_id").alias("a"), F.greatest("query_id", "target_id").alias("b")).agg(
            F.max(F.when(F.col("query_id") < F.col("target_id"), F.col("score"))).alias("there"), F.max(F.when(F.col("query_id") > F.col("target_id"), F.col("score"))).alias("back"),
        )
        one = combine(symmetry, F.col("there"), F.col("back"))
        raw = both.select(F.explode(F.array(F.struct(F.col("a").alias("query_id"), F.col("b").alias("target_id"), one.alias("score")), F.struct(F.col("b").alias("query_id"), F.col("a").alias("target_id"), one.alias("score")))).alias("r")).select("r.*")
    found = pairs.join(raw, ["query_id", "target_id"], "left").join(hits, "query_id")
    if normalize and symmetry is None:
        found = _over(found, "near", "self_hit")
    own = F.lit(1.0) if normalize else F.col("self_hit")
    return found.select("query_id", "target_id", F.when(F.col("query_id") == F.col("target_id"), own).otherwise(F.coalesce("score", F.lit(NAN))).alias("score"))


def _over(scored: DataFrame, *keep: str) -> DataFrame:
    """Scores divided by their query's self-hit, as floating-point numbers are by zero."""
    hit, s = F.col("self_hit"), F.col("score")
    return scored.select("query_id", "target_id", *keep, F.when(hit != 0, F.try_divide(s, hit)).when(s.isNull(), s).when(s == 0, F.lit(NAN)).otherwise(F.signum(s) * F.lit(float("inf"))).alias("score"))
