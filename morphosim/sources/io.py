"""Reading and writing clouds, score tables and skeletons."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bins import ScoreTable
from ..functions.vectors import unit

DOTPROPS = "cloud_id long, point_idx int, x double, y double, z double, tx double, ty double, tz double, alpha double"
SKELETON = "skeleton_id long, node_id long, parent_id long, x double, y double, z double"


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    """name, point_idx, x, y, z of files with a header and columns row label (from 1), X, Y, Z; the file's stem is the name."""
    raw = spark.read.csv(path, header=True, schema="label string, x double, y double, z double", enforceSchema=True)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    return raw.select(F.url_decode(stem).alias("name"), (F.col("label").cast("int") - 1).alias("point_idx"), "x", "y", "z")


def numbered(named: DataFrame, name: str = "name") -> DataFrame:
    """``named`` with ``cloud_id``, dense in the order of names. The names alone are numbered, then joined."""
    ids = named.select(name).distinct().withColumn("cloud_id", (F.row_number().over(W.orderBy(name)) - 1).cast("long"))
    return named.join(ids, name)


def parse_interval(text: str) -> tuple[float, float]:
    """Both ends of an interval's label such as (0,0.5]."""
    low, high = text.strip("([]) ").split(",")
    return float(low), float(high)


def intervals_to_bounds(intervals: Iterable[tuple[float, float]]) -> list[float]:
    """The bounds of intervals that follow each other without gap."""
    out: list[float] = []
    for low, high in intervals:
        if out and out[-1] != low:
            raise ValueError(f"an interval starts at {low}, the one before ends at {out[-1]}")
        out = [*out, high] if out else [low, high]
    return out


def read_score_table(spark: SparkSession, path: str, sep: str = ",") -> ScoreTable:
    """A score table: distance intervals as row labels, dot intervals as column labels. One small file."""
    text = spark.read.text(path, wholetext=True).first()[0]
    head, *rows = [r for r in csv.reader(io.StringIO(text), delimiter=sep) if r]
    return ScoreTable.from_rows(intervals_to_bounds(map(parse_interval, (r[0] for r in rows))), intervals_to_bounds(map(parse_interval, head[1:])), [[float(c) for c in r[1:]] for r in rows])


def read_dotprops_csv(spark: SparkSession, path: str) -> DataFrame:
    """Dotprops of files with columns id, X, Y, Z, i, j, k, alpha; a cloud's points are numbered in the order of its file's rows."""
    raw = spark.read.csv(path, header=True, schema="id long, x double, y double, z double, tx double, ty double, tz double, alpha double")
    # splits of a file are numbered by where they start, rows within a split by their place
    order = W.partitionBy("id").orderBy("file", "start", "row")
    rows = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.col("id").alias("cloud_id"), (F.row_number().over(order) - 1).alias("point_idx"), "x", "y", "z", "tx", "ty", "tz", "alpha")


def read_skeleton_json(spark: SparkSession, path: str, skeleton_id: int = 0) -> DataFrame:
    """A skeleton of an object whose ``data`` has rows [node, parent or null, x, y, z]; ids are read as whole numbers."""
    raw = spark.read.schema("data array<array<string>>").json(path, multiLine=True).select(F.explode("data").alias("r"))
    return raw.select(F.lit(skeleton_id).cast("long").alias("skeleton_id"), F.col("r")[0].cast("long").alias("node_id"), F.col("r")[1].cast("long").alias("parent_id"), *[F.col("r")[i + 2].cast("double").alias(c) for i, c in enumerate("xyz")])


def from_arrays(spark: SparkSession, clouds: dict[int, Sequence[Sequence[float]]]) -> DataFrame:
    """Points of N x 3 arrays by cloud id."""
    rows = []
    for cloud, points in clouds.items():
        for i, p in enumerate(points):
            if len(p) != 3:
                raise ValueError("points must have the shape N x 3")
            rows.append((int(cloud), i, *map(float, p)))
    return spark.createDataFrame(rows, "cloud_id long, point_idx int, x double, y double, z double")


def from_flat(spark: SparkSession, cloud_id: int, flat: Sequence[float]) -> DataFrame:
    """Points of one flat sequence of 3 N numbers."""
    if len(flat) % 3:
        raise ValueError("the length must be a multiple of three")
    return from_arrays(spark, {cloud_id: [flat[i : i + 3] for i in range(0, len(flat), 3)]})


def to_flat(dotprops: DataFrame) -> DataFrame:
    """cloud_id, points and tangents (3 N numbers each) and alphas (N), in order."""
    rows = F.sort_array(F.collect_list(F.struct("point_idx", "x", "y", "z", "tx", "ty", "tz", "alpha")))
    flat = lambda *names: F.flatten(F.transform("r", lambda p: F.array(*[p[n] for n in names])))
    return dotprops.groupBy("cloud_id").agg(rows.alias("r")).select("cloud_id", flat("x", "y", "z").alias("points"), flat("tx", "ty", "tz").alias("tangents"), F.col("r.alpha").alias("alphas"))


def checked_points(points: DataFrame) -> DataFrame:
    """Points whose coordinates are all numbers; a null, NaN or infinite one is an error."""
    bad = F.lit(False)
    for c in "xyz":
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    check = F.when(bad, F.raise_error(F.lit("a point has a coordinate that is no number")).cast("double"))
    return points.withColumn("x", F.coalesce(check, F.col("x")))


def checked_tangents(dotprops: DataFrame) -> DataFrame:
    """Dotprops with tangents scaled to length 1; one without length is an error."""
    return dotprops.withColumns(dict(zip(("tx", "ty", "tz"), unit(F.col("tx"), F.col("ty"), F.col("tz")), strict=True)))


def to_json_lines(dotprops: DataFrame) -> DataFrame:
    """cloud_id and its points as one JSON text, in order."""
    fields = ["point_idx", "x", "y", "z", "tx", "ty", "tz", "alpha"]
    return dotprops.groupBy("cloud_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("json"))


def from_json_lines(texts: DataFrame) -> DataFrame:
    """The reverse of ``to_json_lines``."""
    kind = "array<struct<point_idx:int,x:double,y:double,z:double,tx:double,ty:double,tz:double,alpha:double>>"
    return texts.select("cloud_id", F.inline(F.from_json("json", kind)))


def nested(scores: DataFrame) -> DataFrame:
    """query_id and a map from target_id to score."""
    return scores.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("target_id", "score")))).alias("scores"))


def matrix(scores: DataFrame, targets: Sequence[int]) -> DataFrame:
    """query_id and one column for each of ``targets``."""
    return scores.groupBy("query_id").pivot("target_id", list(targets)).agg(F.first("score"))
