import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from morphosim.functions.bins import Bins, Grid, ScoreTable, UpperTable, exact_quantiles
from morphosim.functions.vectors import SYMMETRIES, augmented, combine, rectified
from morphosim.operators import arbor, training
from morphosim.operators.neighbours import dotprops, grid_matches, nearest, nearest_around, neighbourhoods, point_matches, raw_scores, tangents
from morphosim.operators.scoring import product, scores
from morphosim.plans.arena import Arena
from morphosim.sources import io


def index(spark, bins, values):
    return [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(bins.index(F.col("v"))).collect()]


@pytest.mark.parametrize(("left", "right", "want"), [(True, True, [0, 0, 0, 1, 1, 1]), (False, True, [None, 0, 0, 1, 1, 1]), (True, False, [0, 0, 0, 1, None, None]), (False, False, [None, 0, 0, 1, None, None])])
def test_bin_edges(spark, left, right, want):
    assert index(spark, Bins([1, 2, 3], left, right), [0.5, 1, 1.5, 2, 3, 3.5]) == want


def test_bad_bins():
    for bounds in ([1], [1, 1], [2, 1]):
        with pytest.raises(ValueError, match="bounds"):
            Bins(bounds)
    with pytest.raises(ValueError, match="cells"):
        ScoreTable([0, 1], [0, 1], [1, 2])


def test_linear_falls_short():
    assert Bins.linear(0, 10, 4).bounds == [0, 2, 4, 6, 8]
    assert Bins.linear(0, 10, 4, closed=True).bounds[-1] == 10


def test_grid_is_row_major(spark):
    g = Grid(Bins([0, 1, 2, 3, 4]), Bins([0, 1, 2, 3]))
    rows = spark.createDataFrame([(0.0, 0.0), (1.5, 2.5), (3.5, 2.5)], "a double, b double")
    assert [r[0] for r in rows.select(g.linear(F.col("a"), F.col("b"))).collect()] == [0, 5, 11]


def test_upper_table(spark):
    t = UpperTable([10, 20], [0.5, 1.0], [0, 1, 2, 3])
    rows = spark.createDataFrame([(0.0, 0.0), (10.0, 0.4), (99.0, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(t.score(F.col("a"), F.col("b"))).collect()] == [0, 2, 3]


def test_symmetries(spark):
    pairs = spark.createDataFrame([(0.3, 0.7), (0.0, 0.7), (-1.0, 0.7), (float("nan"), 1.0)], "a double, b double")
    got = {s: [r[0] for r in pairs.select(combine(s, F.col("a"), F.col("b"))).collect()] for s in SYMMETRIES}
    assert got["arithmetic_mean"][0] == pytest.approx(0.5)
    assert got["geometric_mean"][1:3] == [0, 0]
    assert got["harmonic_mean"][0] == pytest.approx(0.42)
    assert got["min"][3] == 1
    assert got["max"][3] == 1
    with pytest.raises(ValueError, match="unknown"):
        combine("none", F.col("a"), F.col("b"))


def test_known_tangent():
    p = np.array([[[0.0, 0, 0], [1, 1, 0], [2, 2, 0], [3, 3, 0]]])
    t, alpha = tangents(p)
    assert np.allclose(t[0], [math.sqrt(0.5), math.sqrt(0.5), 0])
    assert alpha[0] == pytest.approx(1)


def test_nearest_ties_go_to_the_first():
    q, t = np.zeros((1, 3)), np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 0.5]])
    assert nearest(q, t, 3)[0].tolist() == [[2, 0, 1]]
    assert nearest(q, t[:2], 1)[0].tolist() == [[0]]


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(1)
    return dotprops(io.from_arrays(spark, {i: rng.normal(i, 3, (20 + i, 3)) for i in range(4)}), 5).cache()


TABLE = ScoreTable([0, 1, 2, 4], [0, 0.5, 1], [6, 9, 3, 5, -2, -1])


def test_all_against_all(spark, clouds):
    arena = Arena(spark, TABLE, k=5).add_dotprops(clouds)
    raw = {(r[0], r[1]): r[2] for r in arena.all_v_all().collect()}
    assert len(raw) == 16
    assert len(arena) == 4
    norm = {(r[0], r[1]): r[2] for r in arena.all_v_all(normalize=True).collect()}
    assert all(norm[i, i] == 1 for i in range(4))
    assert norm[0, 1] == pytest.approx(raw[0, 1] / raw[0, 0])
    for s in SYMMETRIES:
        got = {(r[0], r[1]): r[2] for r in arena.all_v_all(symmetry=s).collect()}
        assert got[1, 2] == got[2, 1]
    assert raw[2, 2] == pytest.approx(arena.self_hit(2))
    with pytest.raises(IndexError):
        arena.query_target(0, 99)


def test_far_centroids_are_nan(spark, clouds):
    got = {(r[0], r[1]): r[2] for r in scores(clouds, product(clouds, clouds), TABLE, max_centroid_dist=0.0).collect()}
    assert len(got) == 16
    assert all(math.isnan(v) == (q != t) for (q, t), v in got.items())


def test_split_clouds_score_the_same(spark, clouds, monkeypatch):
    import morphosim.operators.neighbours as n

    pairs = product(clouds, clouds).where("query_id <> target_id")
    points = clouds.select("cloud_id", "point_idx", "x", "y", "z")
    near = lambda: sorted(tuple(r) for r in neighbourhoods(points, 4).select("cloud_id", "point_idx", "rank", "nbr_idx", "dist").collect())
    shapes = lambda: sorted(map(tuple, dotprops(points, 5).select("cloud_id", "point_idx", F.round("alpha", 9)).collect()))
    score = lambda: sorted(map(tuple, raw_scores(clouds, pairs, TABLE).collect()))
    match = lambda: sorted(map(tuple, point_matches(clouds, pairs).collect()))
    whole = score(), match(), near(), shapes()
    monkeypatch.setattr(n, "BLOCK", 7)
    split = score(), match(), near(), shapes()
    assert [w[:2] for w in whole[0]] == [s[:2] for s in split[0]]
    assert np.allclose([w[2] for w in whole[0]], [s[2] for s in split[0]])
    assert whole[1:] == split[1:]
    with pytest.raises(Exception, match="fewer points"):
        dotprops(io.from_arrays(spark, {0: np.eye(3), 1: np.random.default_rng(0).random((20, 3))}), 5).collect()


def exact(q, t, k):
    d2 = ((q[:, None] - t[None]) ** 2).transpose(2, 0, 1)
    d2 = d2[0] + d2[1] + d2[2]
    at = np.argsort(d2, axis=1, kind="stable")[:, :k]
    return at, np.take_along_axis(d2, at, 1)


RNG = np.random.default_rng(7)


@pytest.mark.parametrize("t", [
    RNG.random((1500, 3)), RNG.integers(0, 7, (1500, 3)).astype(float), np.c_[RNG.random((900, 2)), np.zeros(900)], np.c_[np.zeros((900, 2)), RNG.random(900)], np.zeros((600, 3)),
    np.r_[RNG.normal(0, 0.01, (900, 3)), RNG.random((50, 3)) * 100], np.c_[RNG.integers(1, 50, 1200), RNG.random(1200) * 50, RNG.integers(0, 11, 1200) * 5.0], RNG.random((3, 3)),
], ids=["even", "lattice", "flat", "line", "point", "dense", "mixed", "few"])
def test_cells_find_what_comparing_all_finds(t):
    q = np.r_[t[:200], RNG.random((100, 3)) * 3 - 1, RNG.normal(0, 500, (20, 3))]
    for k in (1, 3, 20):
        got, want = nearest(q, t, k), exact(q, t, k)
        assert (got[0] == want[0]).all()
        assert (got[1] == want[1]).all()


def exact_around(q, t, cell):
    d2 = ((q[:, None] - t[None]) ** 2).transpose(2, 0, 1)
    d2 = np.where((np.abs(np.floor(q / cell)[:, None] - np.floor(t / cell)[None]) <= 1).all(2), d2[0] + d2[1] + d2[2], np.inf)
    return np.where(np.isfinite(d2.min(1)), d2.argmin(1), -1), d2.min(1)


@pytest.mark.parametrize("t", [
    RNG.random((1500, 3)) * 30, RNG.integers(-9, 9, (1500, 3)).astype(float), RNG.normal(0, 0.2, (900, 3)), np.r_[np.full((400, 3), -3.9), RNG.random((50, 3)) * 100], RNG.random((3, 3)),
    np.c_[RNG.random(2000) * 60, np.full((2000, 2), 7.9)],
], ids=["even", "lattice", "dense", "crowded", "few", "rod"])
def test_cells_around_find_what_comparing_all_in_them_finds(t):
    q = np.r_[t[:200], RNG.random((600, 3)) * 12 - 6, RNG.normal(0, 20, (200, 3)), RNG.normal(0, 500, (20, 3)), np.c_[RNG.random(500) * 60, RNG.random((500, 2)) * 4 - 0.1]]
    for cell in (0.5, 3.0, 4.0):
        got, want = nearest_around(q, t, cell), exact_around(q, t, cell)
        assert (got[0] == want[0]).all()
        assert (got[1] == want[1]).all()


def most_rows(spark, df):
    """The rows of ``df``, and the most that an operator of its plan made."""
    rows = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList(store.executionsCount() - 1, 1).apply(0)
    values, metrics = store.executionMetrics(last.executionId()), last.metrics()
    each = [values.get(m.accumulatorId()) for m in (metrics.apply(i) for i in range(metrics.size())) if m.name() == "number of output rows"]
    return rows, max(int(v.get().replace(",", "")) for v in each if v.isDefined())


def test_grid_matches_make_no_row_for_each_pair_of_points(spark, monkeypatch):
    import morphosim.operators.neighbours as n

    rng = np.random.default_rng(5)
    p = {1: rng.normal(0, 2, (1000, 3)), 2: np.r_[rng.normal(0, 2, (900, 3)), rng.normal(9, 5, (100, 3))], 3: rng.normal(-5, 6, (300, 3))}
    points = io.from_arrays(spark, p)
    pairs = product(points, points).where("query_id < target_id")
    want = []
    for q, t in ((1, 2), (1, 3), (2, 3)):
        at, d2 = exact_around(p[q], p[t], 4.0)
        want += [(q, t, i, int(at[i]), math.sqrt(d2[i])) for i in range(len(at)) if at[i] >= 0]
    got, most = most_rows(spark, grid_matches(points, pairs, 4.0))
    assert sorted(map(tuple, got)) == want
    assert most < 10_000
    for size in (300, 13):
        monkeypatch.setattr(n, "BLOCK", size)
        assert sorted(map(tuple, grid_matches(points, pairs, 4.0).collect())) == want


def test_points_in_no_cell_match_nothing(spark):
    odd = [(1, 0, 1.0, 1.0, 1.0), (1, 1, float("nan"), 0.0, 0.0), (1, 2, None, 0.0, 0.0), (2, 0, float("nan"), 1.0, 1.0), (2, 1, float("inf"), 1.0, 1.0), (2, 2, 1.0, 1.0, 3.0), (3, 0, None, 1.0, 1.0), (3, 1, 1.0, float("-inf"), float("nan"))]
    points = spark.createDataFrame(odd, "cloud_id long, point_idx int, x double, y double, z double")
    assert [tuple(r) for r in grid_matches(points, product(points, points).where("query_id < target_id"), 4.0).collect()] == [(1, 2, 0, 2, 2.0)]


def test_a_cloud_of_many_points(spark):
    p = np.random.default_rng(3).normal(size=(200_000, 3))
    rows = spark.createDataFrame(pa.table({"cloud_id": np.zeros(len(p), np.int64), "point_idx": np.arange(len(p), dtype=np.int32), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    got = neighbourhoods(rows, 3).where("point_idx % 1000 = 7").orderBy("point_idx", "rank").toArrow()
    some = np.arange(7, len(p), 1000)
    want = exact(p[some], p, 3)
    assert got.column("nbr_idx").to_numpy().reshape(-1, 3).tolist() == want[0].tolist()
    assert np.allclose(got.column("dist").to_numpy().reshape(-1, 3), np.sqrt(want[1]))


def test_end_to_end_against_plain_numpy(spark):
    """Points in, normalised geometric means of all pairs out."""
    rng = np.random.default_rng(21)
    points = {i: np.cumsum(rng.normal(size=(int(rng.integers(30, 60)), 3)), 0) + rng.normal(0, 3, 3) for i in range(6)}
    k, table = 5, ScoreTable([0, 1, 3, 8, 30], [0, 0.3, 0.7, 1], [9, 10, 11, 5, 6, 7, 1, 2, 2.5, -9, -8, -7])
    shapes = {}
    for i, p in points.items():
        near = p[exact(p, p, k)[0]]
        c = near - near.mean(1, keepdims=True)
        shapes[i] = np.linalg.svd(c)[2][:, 0]
    bin_of = lambda edges, v: np.clip(np.searchsorted(edges, v, "right") - 1, 0, len(edges) - 2)
    cells = np.array(table.cells).reshape(4, 3)
    raw = np.zeros((6, 6))
    for a in range(6):
        for b in range(6):
            at, d2 = exact(points[a], points[b], 1)
            dot = np.abs((shapes[a] * shapes[b][at[:, 0]]).sum(1))
            raw[a, b] = cells[bin_of(table.dist.bounds, np.sqrt(d2[:, 0])), bin_of(table.dot.bounds, dot)].sum() if a != b else len(at) * cells[0, 2]
    norm = raw / np.diag(raw)[:, None]
    want = np.sqrt(np.maximum(norm, 0) * np.maximum(norm.T, 0))
    arena = Arena(spark, table, k=k).add_points(io.from_arrays(spark, points))
    got = {(r[0], r[1]): r[2] for r in arena.all_v_all(normalize=True, symmetry="geometric_mean").collect()}
    assert len(got) == 36
    assert all(got[a, b] == pytest.approx(want[a, b], abs=1e-10) for a in range(6) for b in range(6))


def test_points_without_a_shape(spark):
    """Neighbours that coincide give an alpha of NaN, which counts as none."""
    p = np.r_[np.zeros((6, 3)), np.random.default_rng(2).random((6, 3)) + 5]
    arena = Arena(spark, TABLE, use_alpha=True, k=5).add_points(io.from_arrays(spark, {0: p, 1: p + 0.1}))
    alphas = np.array([r.alpha for r in arena.cloud(0).collect()])
    assert np.isnan(alphas[:6]).all()
    assert not np.isnan(alphas[6:]).any()
    low = TABLE.cells[0]
    assert arena.self_hit(0) == pytest.approx(6 * low + sum(TABLE.cells[1] if a >= 0.5 else low for a in alphas[6:]))
    raw = {(r[0], r[1]): r[2] for r in arena.all_v_all().collect()}
    assert raw[0, 1] == pytest.approx(6 * low + sum(TABLE.cells[1] if a >= 0.5 else low for a in alphas[6:]))
    assert index(spark, Bins([1, 2, 3]), [float("nan"), 2.5]) == [None, 1]
    one = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double").select(combine("geometric_mean", F.col("a"), F.col("b"))).first()
    assert one[0] == 0


def test_exact_quantiles_without_one_task_for_all(spark):
    rng = np.random.default_rng(4)
    values = {"even": rng.random(20_000), "few": rng.integers(0, 5, 20_000).astype(float), "skewed": np.where(rng.random(20_000) < 0.7, 3.0, rng.random(20_000) * 9)}
    df = spark.createDataFrame(pa.table(values)).repartition(4)
    at = [0, 0.013, 2 / 3, 1]
    for most in (10**6, 500):
        got = exact_quantiles(df, dict.fromkeys(values, at), most)
        for c, v in values.items():
            assert got[c] == pytest.approx(np.quantile(v, at).tolist(), abs=1e-9)
    assert exact_quantiles(df.limit(0), {"even": at}) == {"even": None}


def test_drawn_pairs(spark):
    clouds = spark.range(8).withColumnRenamed("id", "cloud_id")
    sets = spark.createDataFrame([(i // 4, i) for i in range(8)], "set_id long, cloud_id long")
    match, other = training.jobs(clouds, sets, None, 5, 20, 3)
    got = [tuple(r) for r in other.collect()]
    assert len(set(got)) == 20
    assert all(q // 4 != t // 4 for q, t in got)
    assert match.count() == 5
    assert training.jobs(clouds, sets, None, 5, 500, 3)[1].count() == 8 * 4  # all there are


def test_drawn_pairs_list_no_pairs_of_sets(spark):
    """Two large sets and clouds of several: draws are told apart by the sets of both, and none of 2 million pairs is listed."""
    clouds = spark.range(2000).withColumnRenamed("id", "cloud_id")
    sets = spark.createDataFrame([(i % 2, i) for i in range(2000)] + [(2 + i % 7, i) for i in range(0, 1900, 3)], "set_id long, cloud_id long")
    got, most = most_rows(spark, training.jobs(clouds, sets, None, 5, 60, 3)[1])
    assert len({tuple(r) for r in got}) == 60
    of = lambda i: {i % 2, 2 + i % 7} if i < 1900 and i % 3 == 0 else {i % 2}
    assert not any(of(q) & of(t) for q, t in got)
    assert most < 20_000
    given = training.jobs(clouds, sets, spark.createDataFrame([(0, i) for i in range(40)], "set_id long, cloud_id long"), 5, 5000, 3)[1]
    assert {tuple(r) for r in given.collect()} == {(q, t) for q in range(40) for t in range(40) if not of(q) & of(t)}


def of_sets(spark, rows):
    return spark.createDataFrame(rows, "set_id long, cloud_id long").repartition(3)


def test_sampled_pairs_make_no_row_for_each_pair(spark, monkeypatch):
    """Ids of all lengths, pairs of several sets, and tiles of a few clouds: the least of all by md5, from far fewer rows."""
    rng = np.random.default_rng(6)
    ids = [int(x) for x in np.r_[rng.integers(-(10**6), 10**6, 200), rng.integers(-(10**18), 10**18, 100), [0, 7, -(2**63), 2**63 - 1]]]
    rows = [(0, i) for i in ids] + [(1, i) for i in ids[:200]] + [(2 + i, ids[i + j]) for i in range(30) for j in range(2)]
    pairs = {(q, t) for s in range(32) for q in (i for k, i in rows if k == s) for t in (i for k, i in rows if k == s) if q != t}
    want = sorted(pairs, key=lambda p: (hashlib.md5(f"-7:{p[0]}:{p[1]}".encode()).hexdigest(), p))[:50]
    monkeypatch.setattr(training, "TILE", 64)
    got, most = most_rows(spark, training.sampled_of_sets(of_sets(spark, rows), 50, -7))
    assert [tuple(r) for r in got] == want
    assert most < len(pairs) / 20
    assert [tuple(r) for r in training.sampled_of_sets(of_sets(spark, rows), 50, 10**30).collect()] == [tuple(r) for r in training.sampled(training.set_pairs(of_sets(spark, rows)), 50, 10**30).collect()]
    assert training.sampled_of_sets(of_sets(spark, rows[:200]), 10**5, 1).count() == 200 * 199


def test_files(spark, tmp_path):
    (tmp_path / "points").mkdir()
    for name in ("b c", "a"):
        (tmp_path / "points" / f"{name}.csv").write_text('"","X","Y","Z"\n"1",1.5,2,3\n"2",4,5,6\n')
    got = io.numbered(io.read_points_csv(spark, str(tmp_path / "points"))).orderBy("cloud_id", "point_idx").collect()
    assert [(r.name, r.cloud_id, r.point_idx, r.x) for r in got] == [("a", 0, 0, 1.5), ("a", 0, 1, 4.0), ("b c", 1, 0, 1.5), ("b c", 1, 1, 4.0)]
    (tmp_path / "dots.csv").write_text("id,X,Y,Z,i,j,k,alpha\n3,9,0,0,1,0,0,0.5\n3,1,0,0,0,1,0,0.25\n4,0,0,0,0,0,1,1\n")
    got = io.read_dotprops_csv(spark, str(tmp_path / "dots.csv")).orderBy("cloud_id", "point_idx").collect()
    assert [(r.cloud_id, r.point_idx, r.x, r.ty, r.alpha) for r in got] == [(3, 0, 9, 0, 0.5), (3, 1, 1, 1, 0.25), (4, 0, 0, 0, 1)]
    (tmp_path / "tree.json").write_text('{"data": [[9007199254740993, null, 0.5, 1, 2], [2, 9007199254740993, 3, 4, 5]], "other": 1}')
    got = io.read_skeleton_json(spark, str(tmp_path / "tree.json"), 7).orderBy("x").collect()
    assert [(r.skeleton_id, r.node_id, r.parent_id, r.x, r.z) for r in got] == [(7, 2**53 + 1, None, 0.5, 2.0), (7, 2, 2**53 + 1, 3.0, 5.0)]


def test_arrays_and_checks(spark, clouds):
    assert [tuple(r) for r in io.from_flat(spark, 3, range(6)).orderBy("point_idx").collect()] == [(3, 0, 0, 1, 2), (3, 1, 3, 4, 5)]
    with pytest.raises(ValueError, match="three"):
        io.from_flat(spark, 3, range(5))
    with pytest.raises(Exception, match="no number"):
        Arena(spark, TABLE, k=2).add_points(io.from_arrays(spark, {0: [(0, 0, math.inf), (1, 1, 1)]})).clouds.collect()
    with pytest.raises(Exception, match="no length"):
        io.checked_tangents(clouds.withColumn("tx", F.lit(0.0)).withColumn("ty", F.lit(0.0)).withColumn("tz", F.lit(0.0))).collect()
    moved = augmented(clouds, 10.0, 0.1)
    shift = moved.join(clouds.select("cloud_id", "point_idx", F.col("x").alias("was")), ["cloud_id", "point_idx"]).select("cloud_id", (F.col("x") - F.col("was")).alias("d")).groupBy("cloud_id").agg(F.avg("d").alias("m"), F.stddev("d").alias("s")).collect()
    assert all(r.s < 0.5 for r in shift)
    assert np.std([r.m for r in shift]) > 1
    got = {(r[0], r[1]): r[2] for r in Arena(spark, TABLE, k=5).add_dotprops(clouds).query_pairs(product(clouds, clouds), max_centroid_dist=1e9, compat_centroids=True).collect()}
    assert not any(math.isnan(v) for v in got.values())


def test_too_few_points(spark):
    with pytest.raises(Exception, match="fewer than k"):
        dotprops(io.from_arrays(spark, {0: [(0, 0, 0), (1, 1, 1)]}), 5).collect()


def test_rectify(spark):
    rows = spark.createDataFrame([(-1.0, 0.0, 2.0), (0.0, -1.0, 1.0), (0.0, 0.0, -3.0), (1.0, -1.0, -1.0)], "x double, y double, z double")
    got = [tuple(r) for r in rows.select(*rectified(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert [tuple(map(abs, g)) for g in got] == [(1, 0, 2), (0, 1, 1), (0, 0, 3), (1, 1, 1)]
    assert got[0][0] == got[1][1] == 1


def test_score_table_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('"","(0,0.5]","(0.5,1]"\n"(0,1]",1,2\n"(1,2]",3,4\n')
    t = io.read_score_table(spark, str(path))
    assert (t.dist.bounds, t.dot.bounds, t.cells) == ([0, 1, 2], [0, 0.5, 1], [1, 2, 3, 4])
    with pytest.raises(ValueError, match="starts"):
        io.intervals_to_bounds([(0, 1), (2, 3)])


@pytest.fixture(scope="module")
def tree(spark):
    # 1 - 2 - 3, with 3 splitting into 4 - 5 and 6
    rows = [(0, 1, None, 0.0), (0, 2, 1, 1.0), (0, 3, 2, 2.0), (0, 4, 3, 3.0), (0, 5, 4, 4.0), (0, 6, 3, 5.0)]
    return spark.createDataFrame([(s, n, p, x, 0.0, 0.0) for s, n, p, x in rows], arbor.SCHEMA)


@pytest.mark.parametrize(("prune", "left"), [
    (lambda t: arbor.prune_at(t, [4, 99]), {1, 2, 3, 6}), (lambda t: arbor.prune_branches_containing(t, [5]), {1, 2, 3, 6}), (lambda t: arbor.prune_below_strahler(t, 2), {1, 2, 3}),
    (lambda t: arbor.prune_beyond_branches(t, 0), {1, 2, 3}), (lambda t: arbor.prune_beyond_steps(t, 1), {1, 2}), (lambda t: arbor.prune_beyond_distance(t, 3.5), {1, 2, 3, 4}), (lambda t: arbor.prune_twigs(t, 2.5), {1, 2, 3, 6}),
])
def test_pruning(tree, prune, left):
    assert {r["node_id"] for r in prune(tree).collect()} == left


def test_measures(spark, tree):
    assert arbor.cable_length(tree).first()["cable_length"] == 7
    assert arbor.points(tree).count() == 6
    assert arbor.points(tree, 2.0).count() == 4
    bad = spark.createDataFrame([(0, 1, 2, 0.0, 0.0, 0.0), (0, 2, 1, 0.0, 0.0, 0.0)], arbor.SCHEMA)
    with pytest.raises(Exception, match="root"):
        arbor.validated(bad).collect()


def test_stream(spark, clouds, tmp_path):
    from morphosim.streaming.scores import score_stream

    clouds.where("cloud_id = 3").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(clouds.schema).parquet(str(tmp_path / "in"))
    score_stream(arriving, clouds.where("cloud_id < 3").coalesce(1), TABLE, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {(r.query_id, r.target_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(3, 0), (3, 1), (3, 2)}
