"""All queries by name, and their SQL.

Small clouds come from ``embeddings``: a cloud for each label, coordinates from the
first three components, tangents from the next three, alphas from two more. Large
ones come from ``lineitem``, skeletons from ``part`` (a binary tree by key), sets of
clouds that belong together from ``supplier``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.bins import Bins, Grid, ScoreTable, UpperTable
from ..operators import arbor, neighbours, scoring, training
from ..sources import io
from .arena import Arena

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIST, DOT = [0.0, 1.0, 2.0, 4.0, 8.0, 16.0, 40.0], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
CELLS = [round(9.0 - 2.5 * i + (1.5 - 0.1 * i) * j, 4) for i in range(6) for j in range(5)]
TABLE = ScoreTable(DIST, DOT, CELLS)
K = 5


def query(sql: str | None):
    """Register a function under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c, digits: int = 6):
    """Rounded, without negative zeros, so that the order of sums doesn't show."""
    return F.round(c, digits) + F.lit(0.0)


def small_clouds(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    n = F.sqrt(e(3) * e(3) + e(4) * e(4) + e(5) * e(5))
    order = W.partitionBy("label").orderBy("vec_id")
    return _table(spark, d, "embeddings").select(
        F.col("label").cast("long").alias("cloud_id"), (F.row_number().over(order) - 1).alias("point_idx"), *[(e(i) * 20).alias(c) for i, c in enumerate("xyz")],
        *[(e(3 + i) / n).alias(c) for i, c in enumerate(("tx", "ty", "tz"))], (F.abs(e(6)) / (F.abs(e(6)) + F.abs(e(7)))).alias("alpha"),
    )


def large_clouds(spark: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    return _table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("cloud_id"), (F.row_number().over(order) - 1).alias("point_idx"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"), (F.col("l_discount") * 500).alias("z"),
    )


def tree(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return _table(spark, d, "part").select(
        F.lit(0).cast("long").alias("skeleton_id"), p.alias("node_id"), F.when(p > 0, F.floor((p - 1) / 2)).cast("long").alias("parent_id"),
        F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), (p % 17).cast("double").alias("z"),
    )


_L = lambda xs: "[" + ", ".join(repr(float(x)) for x in xs) + "]::DOUBLE[]"
C_SQL = """c AS (SELECT label::BIGINT AS cloud_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS point_idx, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y, embedding[3]::DOUBLE * 20 AS z,
  embedding[4]::DOUBLE / n AS tx, embedding[5]::DOUBLE / n AS ty, embedding[6]::DOUBLE / n AS tz, abs(embedding[7]::DOUBLE) / (abs(embedding[7]::DOUBLE) + abs(embedding[8]::DOUBLE)) AS alpha
  FROM (SELECT *, sqrt(embedding[4]::DOUBLE * embedding[4]::DOUBLE + embedding[5]::DOUBLE * embedding[5]::DOUBLE + embedding[6]::DOUBLE * embedding[6]::DOUBLE) AS n FROM embeddings))"""
G_SQL = """l AS (SELECT l_suppkey AS cloud_id, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount) - 1)::INTEGER AS point_idx, l_quantity AS x, l_extendedprice / 2000 AS y, l_discount * 500 AS z FROM lineitem)"""
M_SQL = C_SQL + """, near AS (SELECT q.cloud_id AS query_id, t.cloud_id AS target_id, q.point_idx AS point_idx,
  arg_min({nbr: t.point_idx, d2: (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) + (q.z - t.z) * (q.z - t.z), dot: abs(q.tx * t.tx + q.ty * t.ty + q.tz * t.tz), al: sqrt(greatest(q.alpha, 0) * greatest(t.alpha, 0))},
    {d2: (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) + (q.z - t.z) * (q.z - t.z), nbr: t.point_idx}) AS m
  FROM c q JOIN c t ON q.cloud_id <> t.cloud_id GROUP BY 1, 2, 3),
m AS (SELECT query_id, target_id, point_idx, m.nbr AS nbr_idx, sqrt(m.d2) AS dist, m.dot AS dot, m.dot * m.al AS adot FROM near)"""


def _bin_sql(bounds, v):
    return f"greatest(0, least({len(bounds) - 2}, len(list_filter({_L(bounds)}, lambda b: b <= {v})) - 1))"


def _score_sql(dist, dot):
    return f"({_L(CELLS)})[{_bin_sql(DIST, dist)} * {len(DOT) - 1} + {_bin_sql(DOT, dot)} + 1]"


RAW_SQL = M_SQL + f", raw AS (SELECT query_id, target_id, sum({_score_sql('dist', 'dot')}) AS s FROM m GROUP BY 1, 2), h AS (SELECT cloud_id, count(*) * {_score_sql('0.0', '1.0')} AS hit, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM c GROUP BY 1)"


def _scores(spark, d, **how) -> DataFrame:
    c = small_clouds(spark, d)
    ids = c.select("cloud_id").distinct()
    return scoring.scores(c, scoring.product(ids, ids), TABLE, **how).select("query_id", "target_id", _r(F.col("score")).alias("score"))


@query(f"WITH {RAW_SQL} SELECT query_id, target_id, round(s, 6) + 0.0 AS score FROM raw UNION ALL SELECT cloud_id, cloud_id, round(hit, 6) + 0.0 FROM h")
def raw_scores(spark, d):
    """A1, A3, Q-f: all against all."""
    return _scores(spark, d)


NORM_SQL = RAW_SQL + ", nrm AS (SELECT query_id, target_id, s / hit AS s FROM raw JOIN h ON cloud_id = query_id)"


@query(f"WITH {NORM_SQL} SELECT query_id, target_id, round(s, 6) + 0.0 AS score FROM nrm UNION ALL SELECT cloud_id, cloud_id, 1.0 FROM h")
def normalized_scores(spark, d):
    """Each raw score over its query's self-hit."""
    return _scores(spark, d, normalize=True)


_COMBINE = {
    "arithmetic_mean": "(a.s + b.s) / 2", "geometric_mean": "sqrt(greatest(a.s, 0) * greatest(b.s, 0))", "min": "least(a.s, b.s)", "max": "greatest(a.s, b.s)",
    "harmonic_mean": "CASE WHEN a.s <= 0 OR b.s <= 0 THEN 0 ELSE 2 / (1 / a.s + 1 / b.s) END",
}
for _name, _how in _COMBINE.items():
    QUERIES[f"sym_{_name}"] = lambda spark, d, s=_name: _scores(spark, d, normalize=True, symmetry=s)
    ORACLES[f"sym_{_name}"] = f"WITH {NORM_SQL} SELECT a.query_id, a.target_id, round({_how}, 6) + 0.0 AS score FROM nrm a JOIN nrm b ON a.query_id = b.target_id AND a.target_id = b.query_id UNION ALL SELECT cloud_id, cloud_id, 1.0 FROM h"


@query(f"WITH {M_SQL} SELECT query_id, target_id, round(sum({_score_sql('dist', 'adot')}), 6) + 0.0 AS score FROM m GROUP BY 1, 2 UNION ALL SELECT cloud_id, cloud_id, round(sum({_score_sql('0.0', 'alpha')}), 6) + 0.0 FROM c GROUP BY 1")
def alpha_scores(spark, d):
    """P10, A4: products scaled by colinearity."""
    return _scores(spark, d, use_alpha=True)


@query(f"WITH {C_SQL} SELECT cloud_id, count(*) AS n_points, round(sum({_score_sql('0.0', 'alpha')}), 6) + 0.0 AS self_hit FROM c GROUP BY 1")
def alpha_self_hit(spark, d):
    return scoring.self_hits(small_clouds(spark, d), TABLE, True).select("cloud_id", "n_points", _r(F.col("self_hit")).alias("self_hit"))


@query(f"WITH {C_SQL} SELECT cloud_id, count(*) * {_score_sql('0.0', '1.0')} AS self_hit FROM c GROUP BY 1")
def self_hit(spark, d):
    return scoring.self_hits(small_clouds(spark, d), TABLE).select("cloud_id", "self_hit")


NEAR = 1.5


@query(f"WITH {RAW_SQL} SELECT a.cloud_id AS query_id, b.cloud_id AS target_id, CASE WHEN a.cloud_id = b.cloud_id THEN round(a.hit, 6) + 0.0 WHEN sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz)) < {NEAR} THEN round(s, 6) + 0.0 ELSE 'NaN'::DOUBLE END AS score FROM h a CROSS JOIN h b LEFT JOIN raw ON raw.query_id = a.cloud_id AND raw.target_id = b.cloud_id")
def centroid_filtered(spark, d):
    """Pairs with far centroids are NaN."""
    return _scores(spark, d, max_centroid_dist=NEAR)


@query(f"WITH {RAW_SQL} SELECT query_id, target_id, round(s, 6) + 0.0 AS score FROM raw WHERE (query_id + 1) % 10 = target_id")
def pair_list_scores(spark, d):
    """A list of pairs with repeats and unknown ids."""
    pairs = spark.createDataFrame([(i, (i + 1) % 10) for i in range(10)] * 2 + [(3, 999), (999, 3)], "query_id long, target_id long")
    return scoring.scores(small_clouds(spark, d), pairs, TABLE).select("query_id", "target_id", _r(F.col("score")).alias("score"))


@query(f"WITH {M_SQL} SELECT query_id, target_id, point_idx, nbr_idx, round(dist, 9) AS dist, round(dot, 9) AS dot FROM m")
def point_matches(spark, d):
    """Every point's nearest match."""
    c = small_clouds(spark, d)
    ids = c.select("cloud_id").distinct()
    m = neighbours.point_matches(c, scoring.product(ids, ids).where("query_id <> target_id"))
    return m.select("query_id", "target_id", "point_idx", "nbr_idx", F.round("dist", 9).alias("dist"), F.round("dot", 9).alias("dot"))


@query(f"WITH {M_SQL} SELECT query_id, target_id, point_idx, nbr_idx, round(dist, 9) AS dist FROM m WHERE query_id < target_id")
def index_matches(spark, d):
    """Neighbours and distances alone."""
    c = small_clouds(spark, d)
    ids = c.select("cloud_id").distinct()
    return neighbours.pair_neighbours(c, scoring.product(ids, ids).where("query_id < target_id")).withColumn("dist", F.round("dist", 9))


KNN_SQL = C_SQL + f", k AS (SELECT a.cloud_id, a.point_idx, b.point_idx AS nbr_idx, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist, b.x AS x, b.y AS y, b.z AS z, row_number() OVER (PARTITION BY a.cloud_id, a.point_idx ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.point_idx) - 1 AS rank FROM c a JOIN c b ON a.cloud_id = b.cloud_id QUALIFY rank < {K})"


@query(f"WITH {KNN_SQL} SELECT cloud_id, point_idx, rank::INTEGER AS rank, nbr_idx, round(dist, 9) AS dist FROM k")
def knn_self(spark, d):
    """Neighbourhoods."""
    return neighbours.neighbourhoods(small_clouds(spark, d).select("cloud_id", "point_idx", *"xyz"), K).withColumn("dist", F.round("dist", 9))


@query(f"WITH {G_SQL} SELECT a.cloud_id, a.point_idx, (row_number() OVER (PARTITION BY a.cloud_id, a.point_idx ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.point_idx) - 1)::INTEGER AS rank, b.point_idx AS nbr_idx FROM l a JOIN l b ON a.cloud_id = b.cloud_id QUALIFY rank < 3")
def knn_large(spark, d):
    """J1 on all large clouds, whose points repeat."""
    return neighbours.neighbourhoods(large_clouds(spark, d), 3).select("cloud_id", "point_idx", "rank", "nbr_idx")


#: Scatter of neighbourhoods, its eigenvalues l1 >= l2 >= l3 by the trigonometric form, and the direction of l1 from (A - l2)(A - l3), whose columns all lie on it.
E_SQL = KNN_SQL + f""", s AS (SELECT cloud_id, point_idx, sum(x * x) - sum(x) * sum(x) / {K} AS xx, sum(y * y) - sum(y) * sum(y) / {K} AS yy, sum(z * z) - sum(z) * sum(z) / {K} AS zz, sum(x * y) - sum(x) * sum(y) / {K} AS xy, sum(x * z) - sum(x) * sum(z) / {K} AS xz, sum(y * z) - sum(y) * sum(z) / {K} AS yz FROM k GROUP BY 1, 2),
e0 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM s), e1 AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM e0),
e2 AS (SELECT *, acos(least(1.0, greatest(-1.0, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (p * p * p) / 2))) / 3 AS phi FROM e1),
e3 AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2.0943951023931953) AS l3 FROM e2), e4 AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM e3),
e5 AS (SELECT *, (xx - l2) * (xx - l3) + xy * xy + xz * xz AS b11, xy * (xx - l3) + (yy - l2) * xy + yz * xz AS b21, xz * (xx - l3) + yz * xy + (zz - l2) * xz AS b31, xy * xy + (yy - l2) * (yy - l3) + yz * yz AS b22, xz * xy + yz * (yy - l3) + (zz - l2) * yz AS b32, xz * xz + yz * yz + (zz - l2) * (zz - l3) AS b33 FROM e4),
e6 AS (SELECT *, CASE WHEN b11 >= b22 AND b11 >= b33 THEN [b11, b21, b31] WHEN b22 >= b33 THEN [b21, b22, b32] ELSE [b31, b32, b33] END AS v FROM e5),
e7 AS (SELECT *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) * CASE WHEN v[1] < 0 OR (v[1] = 0 AND (v[2] < 0 OR (v[2] = 0 AND v[3] < 0))) THEN -1 ELSE 1 END AS n FROM e6),
e AS (SELECT cloud_id, point_idx, v[1] / n AS tx, v[2] / n AS ty, v[3] / n AS tz, (l1 - l2) / (3 * q) AS alpha FROM e7)"""


def _dotprops(spark, d) -> DataFrame:
    return neighbours.dotprops(small_clouds(spark, d).select("cloud_id", "point_idx", *"xyz"), K)


@query(f"WITH {E_SQL} SELECT cloud_id, point_idx, round(alpha, 5) + 0.0 AS alpha FROM e")
def alpha_values(spark, d):
    """Colinearity from eigenvalues."""
    return _dotprops(spark, d).select("cloud_id", "point_idx", _r(F.col("alpha"), 5).alias("alpha"))


@query(f"WITH {E_SQL} SELECT cloud_id, point_idx, round(tx, 4) + 0.0 AS tx, round(ty, 4) + 0.0 AS ty, round(tz, 4) + 0.0 AS tz FROM e")
def tangent_values(spark, d):
    """P5: directions."""
    return _dotprops(spark, d).select("cloud_id", "point_idx", *[_r(F.col(c), 4).alias(c) for c in ("tx", "ty", "tz")])


def _arena(spark, d) -> Arena:
    return Arena(spark, TABLE, k=K).add_points(small_clouds(spark, d).select("cloud_id", "point_idx", *"xyz"))


A_SQL = RAW_SQL.replace(C_SQL, E_SQL.replace("c AS (SELECT label", "c0 AS (SELECT label").replace("FROM c a JOIN c b", "FROM c0 a JOIN c0 b") + ", c AS (SELECT c0.* EXCLUDE (tx, ty, tz, alpha), e.tx, e.ty, e.tz, e.alpha FROM c0 JOIN e USING (cloud_id, point_idx))") + ", nrm AS (SELECT query_id, target_id, s / hit AS s FROM raw JOIN h ON cloud_id = query_id)"


@query(f"WITH {A_SQL} SELECT a.query_id, a.target_id, round(sqrt(greatest(a.s, 0) * greatest(b.s, 0)), 6) + 0.0 AS score FROM nrm a JOIN nrm b ON a.query_id = b.target_id AND a.target_id = b.query_id UNION ALL SELECT cloud_id, cloud_id, 1.0 FROM h")
def arena_all_v_all(spark, d):
    """Q-a to Q-f: points in, all against all out, by the facade."""
    return _arena(spark, d).all_v_all(normalize=True, symmetry="geometric_mean").withColumn("score", _r(F.col("score")))


@query(f"WITH {A_SQL} SELECT query_id, target_id, round(s, 6) + 0.0 AS score FROM raw WHERE query_id IN (1, 2, 3) AND target_id IN (4, 5)")
def arena_queries_targets(spark, d):
    """Q-d: a product of two lists with repeats and an unknown id."""
    return _arena(spark, d).queries_targets([1, 2, 3, 3], [4, 5, 999]).withColumn("score", _r(F.col("score")))


@query(f"WITH {A_SQL}, x AS (SELECT * FROM h WHERE cloud_id = 2), y AS (SELECT * FROM h WHERE cloud_id = 7) SELECT (SELECT count(*) FROM h) AS n, (SELECT round(s, 6) FROM raw WHERE query_id = 2 AND target_id = 7) AS score, (SELECT hit FROM x) AS own, sqrt((x.cx - y.cx) * (x.cx - y.cx) + (x.cy - y.cy) * (x.cy - y.cy) + (x.cz - y.cz) * (x.cz - y.cz)) < {NEAR} AS near, (SELECT count(*) FROM c WHERE cloud_id = 2) AS n_points FROM x, y")
def arena_single_values(spark, d):
    """Q-c, Q-g, Q-h, Q-i, P15: the facade's single values."""
    a = _arena(spark, d)
    row = (len(a.copy()), round(a.query_target(2, 7), 6), a.self_hit(2), a.centroids_within_distance(2, 7, NEAR), a.cloud(2, rectify=True).count())
    return spark.createDataFrame([row], "n long, score double, own double, near boolean, n_points long")


@query(f"WITH {RAW_SQL}, r AS (SELECT query_id, target_id, s FROM raw UNION ALL SELECT cloud_id, cloud_id, hit FROM h) SELECT query_id, {', '.join(f'round(max(s) FILTER (target_id = {i}), 6) + 0.0 AS t{i}' for i in range(10))} FROM r GROUP BY 1")
def score_matrix(spark, d):
    """A column for each target."""
    got = io.matrix(_scores(spark, d), range(10))
    return got.select("query_id", *[_r(F.col(str(i))).alias(f"t{i}") for i in range(10)])


@query(f"WITH {RAW_SQL}, r AS (SELECT query_id, target_id, s FROM raw UNION ALL SELECT cloud_id, cloud_id, hit FROM h) SELECT query_id, target_id, round(s, 6) + 0.0 AS score FROM r")
def score_maps(spark, d):
    """A map for each query, taken apart again."""
    return io.nested(_scores(spark, d)).select("query_id", F.explode("scores").alias("target_id", "score"))


@query(f"WITH {C_SQL} SELECT cloud_id, (point_idx * 3 + i)::INTEGER AS place, round([x, y, z][i + 1], 9) + 0.0 AS point, round([tx, ty, tz][i + 1], 9) + 0.0 AS tangent, round(alpha, 9) AS alpha FROM c, range(3) r(i)")
def flat_arrays(spark, d):
    """Clouds as flat arrays and back."""
    flat = io.to_flat(small_clouds(spark, d))
    at = F.posexplode(F.arrays_zip("points", "tangents"))
    rows = flat.select("cloud_id", "alphas", at.alias("place", "v"))
    return rows.select("cloud_id", "place", _r(F.col("v.points"), 9).alias("point"), _r(F.col("v.tangents"), 9).alias("tangent"), F.round(F.get("alphas", (F.col("place") / 3).cast("int")), 9).alias("alpha"))


_NAN_SQL = C_SQL.replace("c AS (SELECT label", "c9 AS (SELECT label") + ", c AS (SELECT * REPLACE (CASE WHEN point_idx % 7 = 0 THEN 0.0 ELSE alpha END AS alpha) FROM c9)"


@query(f"WITH {M_SQL.replace(C_SQL, _NAN_SQL)} SELECT query_id, target_id, round(sum({_score_sql('dist', 'adot')}), 6) + 0.0 AS score FROM m GROUP BY 1, 2 UNION ALL SELECT cloud_id, cloud_id, round(sum({_score_sql('0.0', 'alpha')}), 6) + 0.0 FROM c GROUP BY 1")
def alpha_scores_without_shape(spark, d):
    """Points whose neighbours coincide have an alpha of NaN, which counts as 0."""
    c = small_clouds(spark, d).withColumn("alpha", F.when(F.col("point_idx") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("alpha")))
    ids = c.select("cloud_id").distinct()
    return scoring.scores(c, scoring.product(ids, ids), TABLE, use_alpha=True).withColumn("score", _r(F.col("score")))


@query(f"WITH {C_SQL}, g AS (SELECT *, floor(x / 4.0) AS gx, floor(y / 4.0) AS gy, floor(z / 4.0) AS gz FROM c) SELECT q.cloud_id AS query_id, t.cloud_id AS target_id, q.point_idx, round(sqrt(min((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) + (q.z - t.z) * (q.z - t.z))), 9) AS dist FROM g q JOIN g t ON q.cloud_id < t.cloud_id AND abs(q.gx - t.gx) <= 1 AND abs(q.gy - t.gy) <= 1 AND abs(q.gz - t.gz) <= 1 GROUP BY 1, 2, 3")
def approximate_matches(spark, d):
    """Only neighbours in the cells around."""
    c = small_clouds(spark, d)
    ids = c.select("cloud_id").distinct()
    m = neighbours.grid_matches(c, scoring.product(ids, ids).where("query_id < target_id"), 4.0)
    return m.select("query_id", "target_id", "point_idx", F.round("dist", 9).alias("dist"))


@query(f"WITH {G_SQL} SELECT cloud_id, count(*) AS n_points, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM l GROUP BY 1")
def cloud_centroids(spark, d):
    """P1, A5."""
    return V.centroids(large_clouds(spark, d)).select("cloud_id", "n_points", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")])


@query(f"WITH {C_SQL}, h AS (SELECT cloud_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM c GROUP BY 1) SELECT cloud_id, point_idx, round(x - cx, 6) + 0.0 AS x, round(y - cy, 6) + 0.0 AS y, round(z - cz, 6) + 0.0 AS z FROM c JOIN h USING (cloud_id)")
def centred_points(spark, d):
    """P2."""
    return V.centred(small_clouds(spark, d)).select("cloud_id", "point_idx", *[_r(F.col(c)).alias(c) for c in "xyz"])


@query(f"WITH {C_SQL}, s AS (SELECT *, CASE WHEN tx < 0 OR (tx = 0 AND (ty < 0 OR (ty = 0 AND tz < 0))) THEN -1.0 ELSE 1.0 END AS s FROM c) SELECT cloud_id, point_idx, round(tx * s, 9) + 0.0 AS tx, round(ty * s, 9) + 0.0 AS ty, round(tz * s, 9) + 0.0 AS tz FROM s")
def rectified_tangents(spark, d):
    """P12, S9."""
    c = io.checked_tangents(small_clouds(spark, d))
    t = V.rectified(F.col("tx"), F.col("ty"), F.col("tz"))
    return c.select("cloud_id", "point_idx", *[_r(v, 9).alias(n) for v, n in zip(t, ("tx", "ty", "tz"), strict=True)])


BOUNDS = [1.0, 10.0, 20.0, 30.0, 50.0]


def _snap_sql(low, high):
    i = f"len(list_filter({_L(BOUNDS)}, lambda b: b <= l_quantity)) - 1"
    return f"CASE WHEN {i} < 0 THEN {low} WHEN {i} >= 4 THEN {high} ELSE {i} END"


@query(f"SELECT l_quantity AS v, ({_snap_sql('0', '3')})::INTEGER AS both, ({_snap_sql('NULL', '3')})::INTEGER AS upper, ({_snap_sql('0', 'NULL')})::INTEGER AS lower, ({_snap_sql('NULL', 'NULL')})::INTEGER AS neither, count(*) AS n FROM lineitem GROUP BY ALL")
def bin_lookup_edges(spark, d):
    """B1, B2: all four ways of snapping."""
    v = F.col("l_quantity")
    kinds = {"both": (True, True), "upper": (False, True), "lower": (True, False), "neither": (False, False)}
    return _table(spark, d, "lineitem").groupBy(v.alias("v"), *[Bins(BOUNDS, *s).index(v).alias(n) for n, s in kinds.items()]).agg(F.count(F.lit(1)).alias("n"))


def _histogram(spark, d, bins: Bins) -> DataFrame:
    return _table(spark, d, "lineitem").groupBy(bins.index(F.col("l_quantity")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _histogram_sql(bounds_sql: str, n: int) -> str:
    return f"WITH b AS (SELECT {bounds_sql} AS b) SELECT greatest(0, least({n - 1}, len(list_filter(b, lambda x: x <= l_quantity)) - 1))::INTEGER AS bin, count(*) AS n FROM lineitem, b GROUP BY 1"


@query(_histogram_sql("list_transform(range(0, 8), lambda i: 1 + (50.0 - 1) / 8 * i)", 7))
def bin_linear(spark, d):
    """The step is a (n + 1)-th."""
    return _histogram(spark, d, Bins.linear(1, 50, 7))


@query(_histogram_sql("list_transform(range(0, 6), lambda i: pow(2.0, 0 + i * (5.5 / 5)))", 5))
def bin_exp(spark, d):
    """B4."""
    return _histogram(spark, d, Bins.exponential(2, 0, 5.5, 5))


@query(_histogram_sql("(SELECT quantile_cont(l_quantity, [0, 0.2, 0.4, 0.6, 0.8]) FROM lineitem)", 4))
def bin_quantiles(spark, d):
    """B5, B6, O1."""
    return _histogram(spark, d, Bins.n_quantiles(_table(spark, d, "lineitem"), "l_quantity", 4))


@query(f"WITH v AS (SELECT l_quantity - 1 AS dist, l_discount * 10 AS dot FROM lineitem) SELECT dist, dot, {_score_sql('dist', 'dot')} AS score, count(*) AS n FROM v GROUP BY ALL")
def range_table_lookup(spark, d):
    """B7 to B11."""
    v = _table(spark, d, "lineitem").select((F.col("l_quantity") - 1).alias("dist"), (F.col("l_discount") * 10).alias("dot"))
    return v.groupBy("dist", "dot", TABLE.score(F.col("dist"), F.col("dot")).alias("score")).agg(F.count(F.lit(1)).alias("n"))


_UP = UpperTable([10, 20, 30, 40, 50], [0.02, 0.04, 0.06, 0.08, 0.1], [float(i) for i in range(25)])


@query("SELECT l_quantity AS dist, l_discount AS dot, (least(4, len(list_filter([10.0, 20, 30, 40, 50]::DOUBLE[], lambda b: b <= l_quantity))) * 5 + least(4, len(list_filter([0.02, 0.04, 0.06, 0.08, 0.1]::DOUBLE[], lambda b: b <= l_discount))))::DOUBLE AS score, count(*) AS n FROM lineitem GROUP BY ALL")
def upper_bound_lookup(spark, d):
    """B12, B13."""
    q, r = F.col("l_quantity"), F.col("l_discount")
    return _table(spark, d, "lineitem").groupBy(q.alias("dist"), r.alias("dot"), _UP.score(q, r).alias("score")).agg(F.count(F.lit(1)).alias("n"))


_GRID = Grid(Bins(BOUNDS, False, False), Bins([0.0, 0.03, 0.06, 0.2], False, False))
_CELL_SQL = f"SELECT ({_snap_sql('NULL', 'NULL')}) * 3 + CASE WHEN l_discount < 0.03 THEN 0 WHEN l_discount < 0.06 THEN 1 ELSE 2 END AS cell, l_returnflag FROM lineitem WHERE l_discount >= 0 AND l_discount < 0.2"


@query("SELECT concat_ws(',', CASE WHEN l_quantity < 10 OR l_quantity >= 40 THEN '0' END, CASE WHEN l_discount < 0.03 OR l_discount >= 0.08 THEN '1' END) AS dims, count(*) AS n FROM lineitem GROUP BY 1")
def out_of_range(spark, d):
    """All dimensions in which a value is in no bin."""
    grid = Grid(Bins([10.0, 20.0, 40.0], False, False), Bins([0.03, 0.05, 0.08], False, False))
    dims = F.concat_ws(",", grid.out_of_range(F.col("l_quantity"), F.col("l_discount")).cast("array<string>"))
    return _table(spark, d, "lineitem").groupBy(dims.alias("dims")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 1 ELSE 2 END)::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def inner_bins(spark, d):
    """Inner bounds, open to both sides."""
    return _histogram(spark, d, Bins.inner([10.0, 30.0]))


@query("SELECT round((l_extendedprice - l_quantity) * l_discount + l_quantity, 6) AS v, count(*) AS n FROM lineitem GROUP BY 1")
def interpolated(spark, d):
    """P13."""
    return _table(spark, d, "lineitem").groupBy(F.round(V.interpolate(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")), 6).alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH g AS ({_CELL_SQL}) SELECT i::INTEGER AS cell, count(g.cell) AS n FROM range(12) t(i) LEFT JOIN g ON g.cell = i GROUP BY 1")
def cell_counts(spark, d):
    """Every cell, also the empty."""
    return _GRID.counts(_table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_discount"))


@query(f"WITH g AS ({_CELL_SQL}), n AS (SELECT i::INTEGER AS cell, count(*) FILTER (l_returnflag = 'R') AS m, count(*) FILTER (l_returnflag = 'N') AS u FROM range(12) t(i) LEFT JOIN g ON g.cell = i GROUP BY 1) SELECT cell, round(log2((m / sum(m) OVER () + 1e-6) / (u / sum(u) OVER () + 1e-6)), 6) + 0.0 AS score FROM n")
def log_odds_table(spark, d):
    """T6, A6."""
    t = _table(spark, d, "lineitem")
    counted = lambda f: _GRID.counts(t.where(F.col("l_returnflag") == f), F.col("l_quantity"), F.col("l_discount"))
    return training.log_odds(counted("R"), counted("N")).select("cell", _r(F.col("score")).alias("score"))


def _sets(spark, d) -> DataFrame:
    return _table(spark, d, "supplier").select(F.col("s_nationkey").alias("set_id"), F.col("s_suppkey").alias("cloud_id"))


PAIR_SQL = "p AS (SELECT DISTINCT a.s_suppkey AS query_id, b.s_suppkey AS target_id FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey)"


def _members(spark, d) -> DataFrame:
    return training.known_sets(_sets(spark, d), _table(spark, d, "supplier").select(F.col("s_suppkey").alias("cloud_id")))


@query(f"WITH {PAIR_SQL} SELECT * FROM p")
def matching_pairs(spark, d):
    """T1, T2."""
    return training.set_pairs(_members(spark, d))


@query("SELECT coalesce(sum(n * (n - 1)), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey HAVING count(*) > 1)")
def pair_bound(spark, d):
    """T4."""
    return training.n_pairs(_members(spark, d))


@query(f"WITH {PAIR_SQL} SELECT query_id, target_id FROM p ORDER BY md5('7:' || query_id || ':' || target_id), 1, 2 LIMIT 40")
def sampled_pairs(spark, d):
    """A sample is what is asked for."""
    return training.sampled_of_sets(_members(spark, d), 40, 7)


def _drawn_sql(ids: str, n: int, seed: int, together: str) -> str:
    """The first n different pairs of a long row of draws that aren't of one set."""
    draw = lambda side: f"('0x' || substr(md5('{seed}:' || i || ':{side}'), 1, 15))::UBIGINT % (SELECT count(*) FROM ({ids}))"
    return f"SELECT query_id, target_id FROM (SELECT x.id AS query_id, y.id AS target_id, min(i) AS i FROM (SELECT i, {draw('q')} AS a, {draw('t')} AS b FROM range({n} * 40) r(i)) JOIN (SELECT id, row_number() OVER (ORDER BY id % 64, id) - 1 AS place FROM ({ids})) x ON x.place = a JOIN (SELECT id, row_number() OVER (ORDER BY id % 64, id) - 1 AS place FROM ({ids})) y ON y.place = b WHERE x.id <> y.id AND NOT ({together}) GROUP BY 1, 2) ORDER BY i LIMIT {n}"


@query(f"WITH {PAIR_SQL} {_drawn_sql('SELECT s_suppkey AS id FROM supplier', 60, 5, 'EXISTS (SELECT 1 FROM p WHERE p.query_id = x.id AND p.target_id = y.id)')}")
def nonmatching_pairs(spark, d):
    """T5: never pairs of a matching set."""
    clouds = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("cloud_id"))
    return training.jobs(clouds, _sets(spark, d), None, None, 60, 5)[1]


TRAIN_SETS = [(0, i) for i in range(5)] + [(1, i) for i in range(5, 10)]


@query(f"""WITH {M_SQL}, b AS (SELECT *, {_bin_sql(DIST, 'dist')} * 5 + {_bin_sql(DOT, 'dot')} AS cell, (query_id < 5) = (target_id < 5) AS good FROM m),
n AS (SELECT i::INTEGER AS cell, count(*) FILTER (good) AS m, count(*) FILTER (NOT good) AS u FROM range(30) t(i) LEFT JOIN b ON b.cell = i GROUP BY 1)
SELECT (cell // 5)::INTEGER AS dist_bin, (cell % 5)::INTEGER AS dot_bin, round(log2((m / sum(m) OVER () + 1e-6) / (u / sum(u) OVER () + 1e-6)), 6) + 0.0 AS score FROM n""")
def trained_table(spark, d):
    """T7 to T11 with given bins and all pairs."""
    sets = spark.createDataFrame(TRAIN_SETS, "set_id int, cloud_id long")
    t = training.train(small_clouds(spark, d), sets, Bins(DIST), Bins(DOT), n_nonmatching=1000)
    return t.to_df(spark).select("dist_bin", "dot_bin", _r(F.col("score")).alias("score"))


@query(f"""WITH {M_SQL}, g AS (SELECT * FROM m WHERE (query_id < 5) = (target_id < 5)), q AS (SELECT quantile_cont(dist, list_transform(range(0, 7), lambda i: i / 7.0)) AS a, quantile_cont(dot, list_transform(range(0, 5), lambda i: i / 5.0)) AS b FROM g),
o AS (SELECT DISTINCT query_id, target_id FROM m WHERE (query_id < 5) <> (target_id < 5)), u AS (SELECT * FROM m SEMI JOIN (SELECT * FROM o ORDER BY md5('0:' || query_id || ':' || target_id), 1, 2 LIMIT 40) USING (query_id, target_id)),
b AS (SELECT good, greatest(0, least(5, len(list_filter(a, lambda x: x <= dist)) - 1)) * 4 + greatest(0, least(3, len(list_filter(b, lambda x: x <= dot)) - 1)) AS cell FROM (SELECT true AS good, dist, dot FROM g UNION ALL SELECT false, dist, dot FROM u), q),
n AS (SELECT i::INTEGER AS cell, count(*) FILTER (good) AS m, count(*) FILTER (NOT good) AS u FROM range(24) t(i) LEFT JOIN b ON b.cell = i GROUP BY 1)
SELECT (cell // 4)::INTEGER AS dist_bin, round(a[cell // 4 + 1], 6) AS dist_lo, round(a[cell // 4 + 2], 6) AS dist_hi, (cell % 4)::INTEGER AS dot_bin, round(b[cell % 4 + 1], 6) AS dot_lo, round(b[cell % 4 + 2], 6) AS dot_hi, round(log2((m / sum(m) OVER () + 1e-6) / (u / sum(u) OVER () + 1e-6)), 6) + 0.0 AS score FROM n, q""")
def trained_quantile_table(spark, d):
    """Quantile bins of the matching matches; as many drawn non-matching pairs."""
    sets = spark.createDataFrame(TRAIN_SETS, "set_id int, cloud_id long")
    t = training.train(small_clouds(spark, d), sets, 6, 4).to_df(spark)
    return t.select("dist_bin", "dot_bin", *[F.round(c, 6).alias(c) for c in ("dist_lo", "dist_hi", "dot_lo", "dot_hi")], _r(F.col("score")).alias("score"))


@query(f"SELECT i // 5 AS dist_bin, i % 5 AS dot_bin, ({_L(DIST)})[i // 5 + 1] AS dist_lo, ({_L(DIST)})[i // 5 + 2] AS dist_hi, ({_L(DOT)})[i % 5 + 1] AS dot_lo, ({_L(DOT)})[i % 5 + 2] AS dot_hi, ({_L(CELLS)})[i + 1] AS score FROM (SELECT i::INTEGER AS i FROM range(30) t(i))")
def score_table(spark, d):
    """S10, M14."""
    return TABLE.to_df(spark)


@query(f"WITH {C_SQL} SELECT cloud_id, point_idx, x, y, z, tx, ty, tz, alpha FROM c")
def json_round_trip(spark, d):
    """Clouds to JSON and back."""
    return io.from_json_lines(io.to_json_lines(small_clouds(spark, d)))


T_SQL = "t AS (SELECT p_partkey AS node_id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS parent_id, p_size::DOUBLE AS x, p_retailprice / 100 AS y, (p_partkey % 17)::DOUBLE AS z FROM part), k AS (SELECT parent_id AS node_id, count(*) AS n FROM t WHERE parent_id IS NOT NULL GROUP BY 1)"
W_SQL = f"WITH RECURSIVE {T_SQL}, w AS (SELECT node_id, parent_id, x, y, z, 0 AS depth, 0.0::DOUBLE AS cable, 0 AS branches FROM t WHERE parent_id IS NULL UNION ALL SELECT t.node_id, t.parent_id, t.x, t.y, t.z, w.depth + 1, w.cable + sqrt((t.x - w.x) * (t.x - w.x) + (t.y - w.y) * (t.y - w.y) + (t.z - w.z) * (t.z - w.z)), w.branches + CASE WHEN k.n > 1 THEN 1 ELSE 0 END FROM t JOIN w ON t.parent_id = w.node_id LEFT JOIN k ON k.node_id = w.node_id)"


def _nodes(df: DataFrame) -> DataFrame:
    return df.select("node_id", "parent_id")


@query(f"{W_SQL} SELECT node_id, parent_id FROM w WHERE depth <= 5")
def prune_beyond_steps(spark, d):
    return _nodes(arbor.prune_beyond_steps(tree(spark, d), 5))


@query(f"{W_SQL} SELECT node_id, parent_id FROM w WHERE cable <= 120.0")
def prune_beyond_distance(spark, d):
    return _nodes(arbor.prune_beyond_distance(tree(spark, d), 120.0))


@query(f"{W_SQL} SELECT node_id, parent_id FROM w WHERE branches <= 4")
def prune_beyond_branches(spark, d):
    return _nodes(arbor.prune_beyond_branches(tree(spark, d), 4))


@query(f"WITH RECURSIVE {T_SQL}, w AS (SELECT node_id, parent_id FROM t WHERE parent_id IS NULL UNION ALL SELECT t.node_id, t.parent_id FROM t JOIN w ON t.parent_id = w.node_id WHERE t.node_id NOT IN (5, 20, 77)) SELECT * FROM w")
def prune_at(spark, d):
    return _nodes(arbor.prune_at(tree(spark, d), [5, 20, 77, 10**9]))


@query(f"WITH {T_SQL} SELECT 0::BIGINT AS skeleton_id, round(sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 4) AS cable_length FROM t a JOIN t b ON a.parent_id = b.node_id")
def cable_length(spark, d):
    """R9, A7."""
    return arbor.cable_length(tree(spark, d)).withColumn("cable_length", F.round("cable_length", 4))


@query(f"WITH {T_SQL} SELECT 0::BIGINT AS skeleton_id, node_id AS root_id FROM t WHERE parent_id IS NULL")
def tree_root(spark, d):
    """R12."""
    return arbor.roots(tree(spark, d))


#: Nodes with depth, cable and the ids on the way from the root, whose order is pre-order.
P_SQL = f"WITH RECURSIVE {T_SQL}, p AS (SELECT node_id, parent_id, x, y, z, 0 AS depth, [node_id] AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.node_id, t.parent_id, t.x, t.y, t.z, p.depth + 1, list_append(p.path, t.node_id) FROM t JOIN p ON t.parent_id = p.node_id), o AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS place FROM p)"


@query(f"{P_SQL} SELECT node_id, parent_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, place FROM o")
def skeleton_rows(spark, d):
    """A tree's rows, in pre-order."""
    return arbor.ordered(tree(spark, d)).select("node_id", "parent_id", *[F.round(c, 6).alias(c) for c in "xyz"], "place")


def _climb(start: str, length: str = "0.0") -> str:
    """From nodes up their unbranched runs: every step, and the last of each."""
    step = "sqrt((c.x - q.x) * (c.x - q.x) + (c.y - q.y) * (c.y - q.y) + (c.z - q.z) * (c.z - q.z))"
    return (
        f"u AS (SELECT c.node_id AS origin, c.node_id, c.parent_id, coalesce({step}, 0.0) AS length FROM t c LEFT JOIN t q ON q.node_id = c.parent_id WHERE {start}"
        f" UNION ALL SELECT u.origin, c.node_id, c.parent_id, u.length + {step} FROM u JOIN t c ON c.node_id = u.parent_id JOIN k ON k.node_id = c.node_id AND k.n = 1 JOIN t q ON q.node_id = c.parent_id),"
        " top AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.origin = u.origin AND v.node_id = u.parent_id))"
    )


def _without(gone: str) -> str:
    return f"w AS (SELECT node_id, parent_id FROM t WHERE parent_id IS NULL AND node_id NOT IN ({gone}) UNION ALL SELECT t.node_id, t.parent_id FROM t JOIN w ON t.parent_id = w.node_id WHERE t.node_id NOT IN ({gone})) SELECT node_id, parent_id FROM w"


@query(f"WITH RECURSIVE {T_SQL}, {_climb('c.node_id IN (5, 20)')}, {_without('SELECT node_id FROM top')}")
def prune_branches_containing(spark, d):
    """R3."""
    return _nodes(arbor.prune_branches_containing(tree(spark, d), [5, 20]))


def _strahler_sql(deepest: int = 26) -> str:
    """Orders level by level, from below; a tree by key is no deeper than its keys have bits."""
    levels = [f"s{deepest} AS (SELECT node_id, parent_id, 1 AS s FROM p WHERE depth >= {deepest})"]
    for i in range(deepest - 1, -1, -1):
        below = f"(SELECT parent_id, m, count(*) FILTER (s = m) AS same FROM (SELECT parent_id, s, max(s) OVER (PARTITION BY parent_id) AS m FROM s{i + 1}) GROUP BY ALL)"
        levels.append(f"s{i} AS (SELECT n.node_id, n.parent_id, CASE WHEN b.m IS NULL THEN 1 WHEN b.same > 1 THEN b.m + 1 ELSE b.m END AS s FROM (SELECT * FROM p WHERE depth = {i}) n LEFT JOIN {below} b ON b.parent_id = n.node_id)")
    return f"{P_SQL}, {', '.join(levels)}, st AS ({' UNION ALL '.join(f'SELECT * FROM s{i}' for i in range(deepest + 1))})"


@query(f"{_strahler_sql()}, {_without('SELECT node_id FROM st WHERE s < 3')}")
def prune_below_strahler(spark, d):
    """R4."""
    return _nodes(arbor.prune_below_strahler(tree(spark, d), 3))


@query(f"WITH RECURSIVE {T_SQL}, {_climb('c.parent_id IS NOT NULL AND c.node_id NOT IN (SELECT node_id FROM k)')}, {_without('SELECT node_id FROM top WHERE length < 12.0')}")
def prune_twigs(spark, d):
    """R7."""
    return _nodes(arbor.prune_twigs(tree(spark, d), 12.0))


@query(f"{_strahler_sql()} SELECT 0::BIGINT AS skeleton_id, node_id, s::INTEGER AS strahler FROM st")
def strahler(spark, d):
    """The orders that R4 goes by."""
    return arbor.strahler(tree(spark, d))


@query(f"""{P_SQL}, b AS (SELECT q.place AS first, c.place AS second, c.node_id, c.x AS x1, c.y AS y1, c.z AS z1, q.x AS x0, q.y AS y0, q.z AS z0, 0.0::DOUBLE AS done FROM o c JOIN o q ON q.node_id = c.parent_id JOIN k ON k.node_id = q.node_id WHERE q.parent_id IS NULL OR k.n > 1
  UNION ALL SELECT b.first, b.second, c.node_id, c.x, c.y, c.z, b.x1, b.y1, b.z1, b.done + sqrt((b.x0 - b.x1) * (b.x0 - b.x1) + (b.y0 - b.y1) * (b.y0 - b.y1) + (b.z0 - b.z1) * (b.z0 - b.z1)) FROM b JOIN k ON k.node_id = b.node_id AND k.n = 1 JOIN t c ON c.parent_id = b.node_id),
e AS (SELECT *, sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1) + (z0 - z1) * (z0 - z1)) AS size FROM b),
m AS (SELECT *, unnest(range((floor(done / 5) + 1)::BIGINT, (floor((done + size) / 5) + 1)::BIGINT)) AS i FROM e WHERE size > 0),
r AS (SELECT -1 AS first, -1 AS second, 0 AS i, x, y, z FROM t WHERE parent_id IS NULL UNION ALL SELECT first, second, i, x0 + (x1 - x0) * (i * 5.0 - done) / size, y0 + (y1 - y0) * (i * 5.0 - done) / size, z0 + (z1 - z0) * (i * 5.0 - done) / size FROM m)
SELECT 0::BIGINT AS skeleton_id, (row_number() OVER (ORDER BY first, second, i) - 1)::INTEGER AS point_idx, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM r""")
def resampled_points(spark, d):
    """R10."""
    return arbor.points(tree(spark, d), 5.0).select("skeleton_id", "point_idx", *[_r(F.col(c), 5).alias(c) for c in "xyz"])
