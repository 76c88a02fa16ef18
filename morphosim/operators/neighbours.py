"""Nearest neighbours between and within clouds.

Clouds are packed into blocks of about ``BLOCK`` points; a cloud of several blocks is
cut along a grid of its own, so that its blocks are compact. Blocks are dealt into
tiles, and a task gets a tile of query blocks, a tile of target blocks and the pairs
that are wanted between them: a block travels once for each tile that it meets, not
once for each pair, and no task holds a whole large cloud. Of a target's several blocks
only those are met that can hold a neighbour, by the bounds of both. Where several
remain, each point's best matches are merged afterwards. Within clouds of one block
each, a block is final and meets nothing else.

Inside a task, the points of a large block lie in the cells of a grid. A query point
looks at the cells around it, in rings, until no cell beyond can hold a nearer point;
what is still open then, or crowded, looks into the leaves of near points whose bounds
can hold a nearer one. All ways give the same.

Ties go to the neighbour with the smallest ``point_idx``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut

BLOCK, TILE = 32768, 65536
#: Up to so many target points all are compared; cells of a grid aim at ``FILL`` points a neighbour wanted, and some of more than ``CROWD`` points are left to the leaves.
FEW, FILL, RINGS, CROWD, LEAF = 256, 0.6, (1, 2), 300, 64
FIELDS = ("x", "y", "z", "tx", "ty", "tz", "alpha")


def _cells(code_bits: int, shares: list[Column]) -> Column:
    """The interleaved bits of three shares from 0 to 1: near points mostly have near codes."""
    side = [F.least(F.lit((1 << code_bits) - 1), F.greatest(F.lit(0), F.floor(s * (1 << code_bits)))).cast("int") for s in shares]
    code = F.lit(0)
    for bit in range(code_bits):
        for axis, c in enumerate(side):
            code = code + F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1)), 3 * bit + axis)
    return code


def _compact(clouds: DataFrame, size: int, bits: int = 6) -> DataFrame:
    """``clouds`` and ``block``: runs of about ``size`` points along the codes of each cloud's grid; a cell's own points go by hash.

    Only counts by cell, at most 2 ** (3 * bits) a cloud, are summed in order.
    """
    bounds = clouds.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    share = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0)
    code = F.when(F.col("n") > size, _cells(bits, [share(c) for c in "xyz"])).otherwise(0)
    coded = cut(clouds.join(bounds, "cloud_id").withColumn("code", code).select(*clouds.columns, "code"), "coded")
    cells = coded.groupBy("cloud_id", "code").agg(F.count(F.lit(1)).alias("cell_n"))
    before = cells.withColumn("before", F.sum("cell_n").over(W.partitionBy("cloud_id").orderBy("code")) - F.col("cell_n"))
    inside = F.pmod(F.xxhash64("point_idx"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("cell_n")
    return coded.join(before, ["cloud_id", "code"]).withColumn("block", F.floor((F.col("before") + inside) / size).cast("int")).select(*clouds.columns, "block")


class Packed:
    """Blocks as rows, and what is known of them: whether a cloud has several, how many points and blocks there are."""

    def __init__(self, clouds: DataFrame, size: int | None = None):
        size = size or BLOCK
        have = [c for c in FIELDS if c in clouds.columns]
        counts = clouds.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
        most, self.points, self.clouds = counts.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        self.several = most > size
        # what is packed and the bounds of blocks are both taken of the cut points, which are written once
        blocked = cut(_compact(clouds.select("cloud_id", "point_idx", *have), size), "blocks") if self.several else clouds.withColumn("block", F.lit(0))
        packed = blocked.groupBy("cloud_id", "block").agg(F.sort_array(F.collect_list(F.struct("point_idx", *have))).alias("p"))
        #: cloud_id, block, idx and an array for each of FIELDS (null where the clouds lack the column), sorted by point_idx
        self.rows = packed.select("cloud_id", "block", F.col("p.point_idx").alias("idx"), *[(F.col(f"p.{c}") if c in have else F.lit(None).cast("array<double>")).alias(c) for c in FIELDS])
        if self.several:
            self.boxes = blocked.groupBy("cloud_id", "block").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])

    def met(self, pairs: DataFrame, k: int, cell: float | None = None) -> DataFrame:
        """query_id, target_id, qb, tb, whole: the pairs of blocks that can hold one of the k nearest.

        All points of a query's block have k neighbours within the largest distance to a
        block of at least k points; blocks that are farther away hold none of them. With a
        ``cell``, only neighbours in the cells around count: blocks whose cells lie apart hold
        none, and a block bounds the distance only if all its points are in the cells around.
        """
        side = lambda p, b: self.boxes.select(F.col("cloud_id").alias(f"{p}_id"), F.col("block").alias(b), F.col("n").alias(f"{b}_n"), *[F.col(f"{e}_{c}").alias(f"{b}_{e}_{c}") for e in ("lo", "hi") for c in "xyz"])
        col, zero = F.col, F.lit(0.0)
        gap = lambda c: F.greatest(zero, col(f"tb_lo_{c}") - col(f"qb_hi_{c}"), col(f"qb_lo_{c}") - col(f"tb_hi_{c}"))
        reach = lambda c: F.greatest(col(f"tb_hi_{c}") - col(f"qb_lo_{c}"), col(f"qb_hi_{c}") - col(f"tb_lo_{c}"))
        each = pairs.join(side("query", "qb"), "query_id").join(side("target", "tb"), "target_id")
        most = sum(reach(c) * reach(c) for c in "xyz")
        sure = col("tb_n") >= k
        if cell:
            at = lambda c: F.floor(col(c) / cell).cast("double")
            each = each.where(F.greatest(*[F.greatest(at(f"tb_lo_{c}") - at(f"qb_hi_{c}"), at(f"qb_lo_{c}") - at(f"tb_hi_{c}")) for c in "xyz"]) <= 1)
            # the distance too, as the numbers of very far cells are all the same
            sure = sure & (F.greatest(*[F.greatest(at(f"tb_hi_{c}") - at(f"qb_lo_{c}"), at(f"qb_hi_{c}") - at(f"tb_lo_{c}")) for c in "xyz"]) <= 1) & (most <= 12 * cell * cell)
        each = each.select("query_id", "target_id", "qb", "tb", sum(gap(c) * gap(c) for c in "xyz").alias("near"), F.when(sure, most).alias("far"))
        of_block = W.partitionBy("query_id", "target_id", "qb")
        some = each.withColumn("least", F.min("far").over(of_block)).where(F.col("least").isNull() | (F.col("near") <= F.col("least") * (1 + 1e-9)))
        return some.withColumn("whole", F.count(F.lit(1)).over(of_block) == 1).select("query_id", "target_id", "qb", "tb", "whole")


def _first(d2: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and values of each row's k smallest, in order; equal ones by name. Missing ones are infinite."""
    if k == 1 and len(name) == 1:
        at = d2.argmin(1)[:, None]
        return name[0][at], np.take_along_axis(d2, at, 1)
    if k == 1:
        best = d2.min(1)
        return np.where(d2 == best[:, None], name, np.iinfo(np.int64).max).min(1)[:, None], best[:, None]
    rows, columns = np.nonzero(d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k])
    found, names = d2[rows, columns], (name[rows, columns] if len(name) == len(d2) else name.ravel()[columns])
    order = np.lexsort((names, found, rows))
    first = np.searchsorted(rows, np.arange(len(d2)))
    at = order[first[:, None] + np.arange(k)]
    return names[at], found[at]


def _squares(q: np.ndarray, t: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of each of q to all of t, or to those of its row in ``at``."""
    out = 0.0
    for c in range(3):
        d = q[:, c][:, None] - (t[:, c] if at is None else t[:, c][at])
        out = out + d * d
    return out


def _all(q: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    step, name = max(1, 2_000_000 // len(t)), np.arange(len(t))[None]
    parts = [_first(_squares(q[a : a + step], t), name, k) for a in range(0, len(q), step)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class CellGrid:
    """The points of a block by the cells of a grid."""

    def __init__(self, t: np.ndarray, k: int):
        self.t, self.low = t, t.min(0)
        span = t.max(0) - self.low
        wide = span > 0
        cells = max(1.0, len(t) / max(1.0, FILL * k))
        self.h = np.ones(3)
        if wide.any():
            self.h[wide] = (np.prod(span[wide]) / cells) ** (1 / wide.sum())
            # thin sides are one cell; the others share what is left
            self.h = np.maximum(self.h, span.max() / 1000)
        self.n = np.maximum(1, np.floor(span / self.h).astype(np.int64) + 1)
        at = np.minimum(np.floor((t - self.low) / self.h).astype(np.int64), self.n - 1)
        code = (at[:, 0] * self.n[1] + at[:, 1]) * self.n[2] + at[:, 2]
        self.order = np.argsort(code, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=int(self.n.prod())))])

    def search(self, q: np.ndarray, k: int, ring: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names and squares of the k nearest in the cells up to ``ring`` away, and whether none beyond can be nearer; none is tried with more than ``most`` points."""
        cell = np.floor((q - self.low) / self.h).clip(-1e9, 1e9).astype(np.int64)
        low, high = np.maximum(cell - ring, 0), np.minimum(cell + ring, self.n - 1)
        side = np.arange(-ring, ring + 1)
        x, y = (cell[:, c, None] + side for c in (0, 1))
        ok = ((x >= 0) & (x < self.n[0]))[:, :, None] & ((y >= 0) & (y < self.n[1]))[:, None, :] & (low[:, 2] <= high[:, 2])[:, None, None]
        base = np.where(ok, (x[:, :, None] * self.n[1] + y[:, None, :]) * self.n[2], 0).reshape(len(q), -1)
        ok = ok.reshape(len(q), -1)
        start = np.where(ok, self.first[np.where(ok, base + low[:, 2:3], 0)], 0)
        size = np.where(ok, self.first[np.where(ok, base + high[:, 2:3] + 1, 0)] - start, 0)
        total = size.sum(1)
        edge = np.minimum(np.where(cell - ring > 0, q - (self.low + (cell - ring) * self.h), np.inf), np.where(cell + ring < self.n - 1, self.low + (cell + ring + 1) * self.h - q, np.inf)).min(1)
        names, squares = _among(q, self.t, self.order, start, size, k, np.flatnonzero((total >= k) & (total <= most)))
        return names, squares, squares[:, -1] < (np.maximum(edge, 0) * (1 - 1e-9)) ** 2


def _among(q: np.ndarray, t: np.ndarray, order: np.ndarray, start: np.ndarray, size: np.ndarray, k: int, todo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and squares of the k nearest of ``todo``'s queries among runs of ``order``: of each query (a row) where they start and how long they are."""
    names, squares = np.zeros((len(q), k), np.int64), np.full((len(q), k), np.inf)
    total = size.sum(1)
    todo, a = todo[np.argsort(total[todo], kind="stable")], 0
    while a < len(todo):
        widest = np.searchsorted(total[todo[a:]] * np.arange(1, len(todo) - a + 1), 2_000_000)
        mine = todo[a : a + max(1, widest)]
        a += len(mine)
        width, lens = int(total[mine[-1]]), size[mine].ravel()
        row = np.repeat(np.repeat(np.arange(len(mine)), size.shape[1]), lens)
        within = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        place = np.arange(len(row)) - np.repeat(np.cumsum(total[mine]) - total[mine], total[mine])
        at = np.zeros((len(mine), width), np.int64)
        at[row, place] = order[np.repeat(start[mine].ravel(), lens) + within]
        d2 = _squares(q[mine], t, at)
        d2[np.arange(width)[None] >= total[mine][:, None]] = np.inf
        names[mine], squares[mine] = _first(d2, at, k)
    return names, squares


class Leaves:
    """The points of a block in leaves of near ones, by the interleaved bits of their ranks along each axis, so that dense parts have small leaves."""

    def __init__(self, t: np.ndarray, k: int):
        n = len(t)
        code = np.zeros(n, np.int64)
        for axis in range(3):
            rank = np.empty(n, np.int64)
            rank[np.argsort(t[:, axis], kind="stable")] = np.arange(n)
            for bit in range(10):
                code |= ((rank * 1024 // n) >> bit & 1) << (3 * bit + axis)
        self.order = np.argsort(code, kind="stable")
        self.start = np.arange(0, n, max(LEAF, k))
        self.size = np.diff(np.append(self.start, n))
        self.sorted = t[self.order]
        self.low, self.high = (f.reduceat(self.sorted, self.start) for f in (np.minimum, np.maximum))

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest: the nearest leaf gives a bound, and only leaves within it are looked into, each for all its queries at once."""
        near = np.zeros((len(q), len(self.start)))
        for axis in range(3):
            x = q[:, axis, None]
            near += np.maximum(np.maximum(self.low[:, axis] - x, x - self.high[:, axis]), 0) ** 2
        first = near.argmin(1)
        names, squares = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), np.inf)
        for own in (True, False):
            for leaf, (a, n) in enumerate(zip(self.start, self.size, strict=True)):
                rows = np.flatnonzero(first == leaf if own else (first != leaf) & (near[:, leaf] <= squares[:, -1] * (1 + 1e-9)))
                if len(rows):
                    d2 = np.concatenate([squares[rows], _squares(q[rows], self.sorted[a : a + n])], 1)
                    name = np.concatenate([names[rows], np.broadcast_to(self.order[a : a + n], (len(rows), n))], 1)
                    names[rows], squares[rows] = _first(d2, name, k)
        return names, squares


def nearest(q: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``t`` and squared distances of the k nearest of each of ``q``; equal ones in order of place."""
    k = min(k, len(t))
    if len(t) <= FEW or len(q) < 16:
        return _all(q, t, k)
    grid, open_ = CellGrid(t, k), np.arange(len(q))
    where, far = np.empty((len(q), k), np.int64), np.empty((len(q), k))
    for ring in RINGS:
        left = []
        for a in range(0, len(open_), 8192):
            mine = open_[a : a + 8192]
            names, squares, done = grid.search(q[mine], k, ring, CROWD + 4 * k)
            where[mine[done]], far[mine[done]] = names[done], squares[done]
            left.append(mine[~done])
        open_ = np.concatenate(left)
        if not len(open_):
            return where, far
    leaves = Leaves(t, k)
    for a in range(0, len(open_), 8192):
        mine = open_[a : a + 8192]
        where[mine], far[mine] = leaves.search(q[mine], k)
    return where, far


def nearest_around(q: np.ndarray, t: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``t`` and squared distances of each of ``q``'s nearest in its cell of side ``cell`` or the 26 around it; -1 where these are empty.

    Where the nearest of all lies outside, the cells around are looked into: a few points
    are all compared, of many all queries of a cell search together.
    """
    at, d2 = nearest(q, t, 1)
    where, far = at[:, 0], d2[:, 0]
    mine, theirs = np.floor(q / cell), np.floor(t / cell)
    open_ = np.flatnonzero((np.abs(mine - theirs[where]) > 1).any(1))
    if not len(open_):
        return where, far
    where[open_], far[open_] = -1, np.inf
    # cells by the ranks of their numbers along each axis; those around are up to three ranks from ``low``, and runs along the last axis
    marks = [np.unique(theirs[:, c]) for c in range(3)]
    code = np.zeros(len(t), np.int64)
    for c in range(3):
        code = code * len(marks[c]) + np.searchsorted(marks[c], theirs[:, c])
    order = np.argsort(code, kind="stable")
    code = code[order]
    low, high = (np.stack([np.searchsorted(marks[c], mine[open_, c] + by, side) for c in range(3)], 1) for by, side in ((-1, "left"), (1, "right")))
    three = np.arange(3)
    x, y = (low[:, c, None] + three for c in (0, 1))
    ok = ((x < high[:, 0, None])[:, :, None] & (y < high[:, 1, None])[:, None, :]).reshape(len(open_), 9)
    base = ((x[:, :, None] * len(marks[1]) + y[:, None, :]) * len(marks[2])).reshape(len(open_), 9)
    start = np.searchsorted(code, base + low[:, 2, None])
    size = np.where(ok, np.searchsorted(code, base + high[:, 2, None]) - start, 0)
    total = size.sum(1)
    few = np.flatnonzero((total > 0) & (total <= CROWD))
    names, squares = _among(q[open_], t, order, start, size, 1, few)
    where[open_[few]], far[open_[few]] = names[few, 0], squares[few, 0]
    many = np.flatnonzero(total > CROWD)
    if len(many):
        _, first, group = np.unique(mine[open_[many]], axis=0, return_index=True, return_inverse=True)
        by_cell = np.argsort(group.ravel(), kind="stable")
        for one, rows in zip(many[first], np.split(many[by_cell], np.cumsum(np.bincount(group.ravel()))[:-1]), strict=True):
            there = np.sort(np.concatenate([order[a : a + n] for a, n in zip(start[one], size[one], strict=True)]))
            at, d2 = nearest(q[open_[rows]], t[there], 1)
            where[open_[rows]], far[open_[rows]] = there[at[:, 0]], d2[:, 0]
    return where, far


def _table(columns: list, out: pa.Schema) -> pa.Table:
    return pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def _schema(kinds: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, types[k]) for n, k in (x.split() for x in kinds.split(", "))])


def _block(get: Callable) -> tuple:
    """point_idx, points, tangents and alphas of a block's row."""
    a = {c: (np.asarray(v.values) if (v := get(c)).is_valid else None) for c in ("idx", *FIELDS)}
    return a["idx"], np.stack([a[c] for c in "xyz"], 1), np.stack([a[c] for c in ("tx", "ty", "tz")], 1) if a["tx"] is not None else None, a["alpha"]


def _alone(packed: Packed, kernel: Callable, kinds: str) -> DataFrame:
    """Run ``kernel(block, cloud_id)`` for every block, which is a whole cloud."""
    out = _schema(kinds)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(batch.schema.get_field_index(c))[r]  # noqa: B023, E731
                yield from _table(kernel(_block(get), get("cloud_id").as_py()), out).to_batches()

    return packed.rows.repartition(max(1, min(packed.clouds, max(-(-packed.points // TILE), 2 * packed.rows.sparkSession.sparkContext.defaultParallelism))), "cloud_id").mapInArrow(run, kinds)


def _meet(packed: Packed, pairs: DataFrame, kernel: Callable, kinds: str, k: int = 1, cell: float | None = None) -> DataFrame:
    """Run ``kernel(query block, target block, query_id, target_id, whole)`` for all blocks of wanted pairs, tile by tile."""
    n = max(-(-packed.points // TILE), min(4, packed.clouds), 1)  # some tiles even of few blocks, for the cores
    tile = lambda c, b: F.pmod(F.xxhash64(c, b), F.lit(n)).cast("int")
    each = packed.met(pairs, k, cell) if packed.several else pairs.select("query_id", "target_id", F.lit(0).alias("qb"), F.lit(0).alias("tb"), F.lit(True).alias("whole"))
    each = each.select(tile("query_id", "qb").alias("i"), tile("target_id", "tb").alias("j"), "query_id", "qb", "target_id", "tb", "whole")
    arrays = ["idx", *FIELDS]
    # a row for both blocks and one for the pair itself, whose block number is that of no block, so it meets none in the join
    none_long, none_int, none = F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("boolean")
    row = lambda c, b, other, other_block, whole, own: F.struct(F.col(c).alias("cloud_id"), b.alias("block"), other.alias("other"), other_block.alias("other_block"), whole.alias("whole"), own.alias("own"))
    apart = (-1 - F.pmod(F.xxhash64("target_id", "tb"), F.lit(1 << 30))).cast("int")
    three = F.array(
        row("query_id", F.col("qb"), none_long, none_int, none, none_int), row("target_id", F.col("tb"), none_long, none_int, none, none_int),
        row("query_id", apart, F.col("target_id"), F.col("tb"), F.col("whole"), F.col("qb")),
    )
    rows = each.select("i", "j", F.explode(three).alias("r")).select("i", "j", "r.*").distinct().join(packed.rows, ["cloud_id", "block"], "left")
    out = _schema(kinds)

    def run(group: pa.Table) -> pa.Table:
        other = group.column("other").to_numpy(zero_copy_only=False)
        ids, parts = group.column("cloud_id").to_numpy(), group.column("block").to_numpy()
        is_cloud = np.array(group.column("other").is_null())
        held = {}
        for r in np.flatnonzero(is_cloud):
            if group.column("idx")[int(r)].is_valid:
                held[ids[r], parts[r]] = _block(lambda c: group.column(c)[int(r)])  # noqa: B023
        own = group.column("own").to_numpy(zero_copy_only=False)
        block2, whole = group.column("other_block").to_numpy(zero_copy_only=False), group.column("whole").to_numpy(zero_copy_only=False)
        wanted = [((ids[r], int(own[r])), (int(other[r]), int(block2[r])), bool(whole[r])) for r in np.flatnonzero(~is_cloud)]
        found = [kernel(held[a], held[b], a[0], b[0], w) for a, b, w in wanted if a in held and b in held]
        return pa.concat_tables([_table(t, out) for t in found]) if found else out.empty_table()

    return rows.select("i", "j", "cloud_id", "block", "other", "other_block", "whole", "own", *arrays).groupBy("i", "j").applyInArrow(run, kinds)


def _dots(q, t, at: np.ndarray, use_alpha: bool) -> np.ndarray:
    """Absolute products of tangents, scaled by both alphas if ``use_alpha``; an alpha of NaN counts as none, as does a negative one."""
    dot = np.abs((q[2] * t[2][at]).sum(1)) if q[2] is not None else np.ones(len(at))
    return dot * np.sqrt(np.fmax(q[3], 0) * np.fmax(t[3][at], 0)) if use_alpha else dot


def point_matches(clouds: DataFrame, pairs: DataFrame, use_alpha: bool = False) -> DataFrame:
    """query_id, target_id, point_idx, nbr_idx, dist, dot: each query point's nearest target point.

    ``pairs`` (query_id, target_id) are distinct; ids that ``clouds`` lacks drop out. ``dot`` is the
    absolute product of the tangents, scaled by both alphas if ``use_alpha``.
    """

    def kernel(q, t, query, target, whole):
        at, d2 = nearest(q[1], t[1], 1)
        at = at[:, 0]
        n = len(at)
        return [np.full(n, query), np.full(n, target), q[0], t[0][at], np.sqrt(d2[:, 0]), _dots(q, t, at, use_alpha)]

    packed = Packed(clouds)
    found = _meet(packed, pairs, kernel, "query_id long, target_id long, point_idx int, nbr_idx int, dist double, dot double")
    if not packed.several:
        return found
    return found.groupBy("query_id", "target_id", "point_idx").agg(F.min(F.struct("dist", "nbr_idx", "dot")).alias("m")).select("query_id", "target_id", "point_idx", F.col("m.nbr_idx").alias("nbr_idx"), F.col("m.dist").alias("dist"), F.col("m.dot").alias("dot"))


def raw_scores(clouds: DataFrame, pairs: DataFrame, table, use_alpha: bool = False) -> DataFrame:
    """query_id, target_id, score: the sum of the scores of all query points' matches.

    A task sums whole targets itself, so one row a pair and block leaves it; only
    targets of several blocks hand on their points.
    """
    edges_dist, edges_dot, cells = table.arrays()

    def kernel(q, t, query, target, whole):
        at, d2 = nearest(q[1], t[1], 1)
        at, dist = at[:, 0], np.sqrt(d2[:, 0])
        dot = _dots(q, t, at, use_alpha)
        score = cells[np.searchsorted(edges_dist, dist, "right"), np.searchsorted(edges_dot, dot, "right")]
        if whole:
            return [[query], [target], pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()), [score.sum()]]
        n = len(at)
        return [np.full(n, query), np.full(n, target), q[0], t[0][at], dist, score]

    packed = Packed(clouds)
    found = _meet(packed, pairs, kernel, "query_id long, target_id long, point_idx int, nbr_idx int, dist double, score double")
    if not packed.several:
        return found.select("query_id", "target_id", "score")
    split = found.where("point_idx is not null").groupBy("query_id", "target_id", "point_idx").agg(F.min(F.struct("dist", "nbr_idx", "score")).alias("m")).select("query_id", "target_id", F.col("m.score").alias("score"))
    return found.where("point_idx is null").select("query_id", "target_id", "score").union(split).groupBy("query_id", "target_id").agg(F.sum("score").alias("score"))


def _itself(points: DataFrame) -> DataFrame:
    return points.select(F.col("cloud_id").alias("query_id")).distinct().withColumn("target_id", F.col("query_id"))


def neighbourhoods(points: DataFrame, k: int) -> DataFrame:
    """cloud_id, point_idx, rank (from 0), nbr_idx, dist: the k nearest points of the same cloud, the point itself included."""
    packed = Packed(points)

    def rows(q, t, query, ranked: bool):
        at, d2 = nearest(q[1], t[1], k)
        n, m = at.shape
        return [np.full(n * m, query), np.repeat(q[0], m), *([np.tile(np.arange(m), n)] * ranked), t[0][at].ravel(), np.sqrt(d2).ravel()]

    if not packed.several:
        return _alone(packed, lambda q, cloud: rows(q, q, cloud, True), "cloud_id long, point_idx int, rank int, nbr_idx int, dist double")
    found = _meet(packed, _itself(points), lambda q, t, query, target, whole: rows(q, t, query, False), "cloud_id long, point_idx int, nbr_idx int, dist double", k)
    best = found.groupBy("cloud_id", "point_idx").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "nbr_idx"))), 1, k).alias("e"))
    return best.select("cloud_id", "point_idx", F.posexplode("e").alias("rank", "m")).select("cloud_id", "point_idx", "rank", F.col("m.nbr_idx").alias("nbr_idx"), F.col("m.dist").alias("dist"))


def tangents(neighbours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit direction of greatest spread, its first component other than zero positive, and colinearity of neighbourhoods (n x k x 3)."""
    centred = neighbours - neighbours.mean(1, keepdims=True)
    values, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", centred, centred))
    t = vectors[:, :, 2]
    first = np.take_along_axis(t, (np.abs(t) > 0).argmax(1)[:, None], 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return t * np.where(first < 0, -1.0, 1.0), (values[:, 2] - values[:, 1]) / values.sum(1)


def dotprops(points: DataFrame, k: int = 20) -> DataFrame:
    """Points with tangent and alpha of their k-point neighbourhoods. A cloud with fewer than k points is an error.

    Neighbourhoods whose points coincide have an alpha of NaN.
    """
    packed = Packed(points)
    lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(a.ravel(), kind))
    kinds = "cloud_id long, point_idx int, x double, y double, z double, tx double, ty double, tz double, alpha double"
    least = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))

    def alone(q, cloud):
        if len(q[1]) < k:
            raise ValueError(f"cloud {cloud} has {len(q[1])} points, fewer than k = {k}")
        t, alpha = tangents(q[1][nearest(q[1], q[1], k)[0]])
        return [np.full(len(t), cloud), q[0], *q[1].T, *t.T, alpha]

    if not packed.several:
        return _alone(packed, alone, kinds)

    def kernel(q, t, query, target, whole):
        at, d2 = nearest(q[1], t[1], k)
        return [np.full(len(at), query), q[0], *q[1].T, lists(d2, pa.float64()), lists(t[0][at].astype(np.int32), pa.int32()), *(lists(t[1][at][:, :, c], pa.float64()) for c in range(3))]

    checked = _itself(points).join(least.select(F.col("cloud_id").alias("query_id"), "n"), "query_id").where(F.when(F.col("n") >= k, True).otherwise(F.raise_error(F.lit(f"a cloud has fewer points than k = {k}")).cast("boolean")))
    near = _meet(packed, checked.select("query_id", "target_id"), kernel, "cloud_id long, point_idx int, x double, y double, z double, far array<double>, nbr array<int>, nx array<double>, ny array<double>, nz array<double>", k)
    entry = F.arrays_zip("far", "nbr", "nx", "ny", "nz")
    merged = near.groupBy("cloud_id", "point_idx", "x", "y", "z").agg(F.slice(F.array_sort(F.flatten(F.collect_list(entry))), 1, k).alias("e"))
    near = merged.select("cloud_id", "point_idx", "x", "y", "z", *[F.col(f"e.{c}").alias(c) for c in ("nx", "ny", "nz")])

    def run(batches):
        for b in batches:
            if b.num_rows:
                get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
                n = np.stack([get(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("nx", "ny", "nz")], 2)
                t, alpha = tangents(n)
                yield pa.RecordBatch.from_arrays([*(get(c) for c in ("cloud_id", "point_idx", "x", "y", "z")), *(pa.array(t[:, c]) for c in range(3)), pa.array(alpha)], ["cloud_id", "point_idx", "x", "y", "z", "tx", "ty", "tz", "alpha"])

    return near.mapInArrow(run, kinds)


def pair_neighbours(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, target_id, point_idx, nbr_idx, dist, without tangents or scores."""
    return point_matches(points.select("cloud_id", "point_idx", "x", "y", "z"), pairs).drop("dot")


def grid_matches(points: DataFrame, pairs: DataFrame, cell: float) -> DataFrame:
    """query_id, target_id, point_idx, nbr_idx, dist: an approximate nearest match, only of target points in a query point's grid cell or the 26 around it.

    Points with no target point that near are left out, as are those with a coordinate that is
    null or not finite, which are in no cell. Whoever needs all takes ``pair_neighbours``.
    """

    def kernel(q, t, query, target, whole):
        at, d2 = nearest_around(q[1], t[1], cell)
        have = at >= 0
        n = int(have.sum())
        return [np.full(n, query), np.full(n, target), q[0][have], t[0][at[have]], np.sqrt(d2[have])]

    finite = lambda c: F.abs(F.col(c)) < float("inf")
    packed = Packed(points.select("cloud_id", "point_idx", *"xyz").where(finite("x") & finite("y") & finite("z")))
    found = _meet(packed, pairs, kernel, "query_id long, target_id long, point_idx int, nbr_idx int, dist double", cell=cell)
    if not packed.several:
        return found
    return found.groupBy("query_id", "target_id", "point_idx").agg(F.min(F.struct("dist", "nbr_idx")).alias("m")).select("query_id", "target_id", "point_idx", F.col("m.nbr_idx").alias("nbr_idx"), F.col("m.dist").alias("dist"))
