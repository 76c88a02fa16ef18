"""The facade: a set of clouds, a score table, and queries over them."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.bins import ScoreTable
from ..functions.vectors import rectified
from ..operators.neighbours import dotprops
from ..operators.scoring import product, scores, self_hits, within
from ..sources.io import checked_points, checked_tangents

BACKEND = "spark"


def version() -> str:
    return __version__


class Arena:
    """Immutable: adding clouds gives a new arena. Parallelism is the cluster's."""

    def __init__(self, spark: SparkSession, table: ScoreTable, use_alpha: bool = False, k: int = 20, clouds: DataFrame | None = None):
        self.spark, self.table, self.use_alpha, self.k, self.clouds = spark, table, use_alpha, k, clouds

    def _with(self, more: DataFrame) -> Arena:
        return Arena(self.spark, self.table, self.use_alpha, self.k, more if self.clouds is None else self.clouds.unionByName(more))

    def add_points(self, points: DataFrame) -> Arena:
        """Points (cloud_id, point_idx, x, y, z); tangents come from k-point neighbourhoods."""
        return self._with(dotprops(checked_points(points), self.k))

    def add_dotprops(self, clouds: DataFrame, validate: bool = False) -> Arena:
        """Points with unit tangents, and alphas if this arena uses them."""
        if "alpha" not in clouds.columns:
            if self.use_alpha:
                raise ValueError("this arena uses alphas, none were given")
            warnings.warn("no alphas given", PendingDeprecationWarning, stacklevel=2)
            clouds = clouds.withColumn("alpha", F.lit(1.0))
        clouds = clouds.select("cloud_id", "point_idx", "x", "y", "z", "tx", "ty", "tz", "alpha")
        return self._with(checked_tangents(checked_points(clouds)) if validate else clouds)

    @property
    def summary(self) -> DataFrame:
        return self_hits(self.clouds, self.table, self.use_alpha)

    def ids(self) -> DataFrame:
        return self.clouds.select("cloud_id").distinct()

    def __len__(self) -> int:
        return 0 if self.clouds is None else self.ids().count()

    def query_pairs(self, pairs: DataFrame, normalize: bool = False, symmetry: str | None = None, max_centroid_dist: float | None = None, compat_centroids: bool = False) -> DataFrame:
        return scores(self.clouds, pairs, self.table, self.use_alpha, normalize, symmetry, max_centroid_dist, compat_centroids)

    def queries_targets(self, queries: Sequence[int], targets: Sequence[int], **how) -> DataFrame:
        ids = lambda x: self.spark.createDataFrame([(int(i),) for i in x], "cloud_id long")
        return self.query_pairs(product(ids(queries), ids(targets)), **how)

    def all_v_all(self, **how) -> DataFrame:
        return self.query_pairs(product(self.ids(), self.ids()), **how)

    def query_target(self, query: int, target: int, normalize: bool = False, symmetry: str | None = None) -> float:
        got = self.queries_targets([query], [target], normalize=normalize, symmetry=symmetry).collect()
        if not got:
            raise IndexError(f"unknown cloud among {query}, {target}")
        return got[0]["score"]

    def centroids_within_distance(self, query: int, target: int, most: float) -> bool | None:
        pair = self.spark.createDataFrame([(query, target)], "query_id long, target_id long")
        got = within(pair, self.summary, most).first()
        return got and got["near"]

    def self_hit(self, cloud: int) -> float:
        got = self.summary.where(F.col("cloud_id") == cloud).first()
        if got is None:
            raise IndexError(f"unknown cloud {cloud}")
        return got["self_hit"]

    def cloud(self, cloud: int, rectify: bool = False) -> DataFrame:
        """Points, tangents and alphas of one cloud, in order."""
        one = self.clouds.where(F.col("cloud_id") == cloud)
        if rectify:
            one = one.withColumns(dict(zip(("tx", "ty", "tz"), rectified(F.col("tx"), F.col("ty"), F.col("tz")), strict=True)))
        return one.orderBy("point_idx")

    def copy(self) -> Arena:
        return Arena(self.spark, self.table, self.use_alpha, self.k, self.clouds)
