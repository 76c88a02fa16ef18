"""Bins and lookup tables as Column expressions that stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows that a single task may take quantiles of.
MOST = 2_000_000


def exact_quantiles(df: DataFrame, columns: dict[str, Sequence[float]], most: int | None = None) -> dict[str, list[float] | None]:
    """Exact, linearly interpolated quantiles of columns, null where a column has no values.

    Up to ``most`` rows one task counts the values. Beyond, approximate quantiles give
    bounds around each place, the rows below and between them are counted, and only
    those between are searched on: a scan or two a thousandfold of rows.
    """
    most = most or MOST
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    small = {c: at for c, at in columns.items() if 0 < counts[c] <= most}
    out: dict[str, list[float] | None] = dict.fromkeys(columns)
    if small:
        out |= df.agg(*[F.percentile(F.col(c), F.array(*[F.lit(float(q)) for q in at])).alias(c) for c, at in small.items()]).first().asDict()
    for c, at in columns.items():
        if counts[c] > most:
            out[c] = [_at_place(df.select(F.col(c).cast("double").alias("v")).where("v is not null"), counts[c], float(q) * (counts[c] - 1), most) for q in at]
    return out


def _at_place(rows: DataFrame, n: int, place: float, most: int) -> float:
    """The value at a place (from 0, interpolated) of n values v in order."""
    v, wide = F.col("v"), 4e-4
    while n > most:
        ends = [F.lit(min(1.0, max(0.0, place / (n - 1) + w))) for w in (-wide, wide)]
        low, high = rows.agg(F.percentile_approx("v", F.array(*ends), F.lit(10_000)).alias("q")).first()["q"]
        below, inside = rows.agg(F.count(F.when(v < low, 1)), F.count(F.when((v >= low) & (v <= high), 1))).first()
        if place < below or place > below + inside - 1:
            wide *= 4  # the bounds missed it
        elif low == high:
            return low
        elif inside > 0.9 * n:  # few values, often repeated
            share = place / (n - 1)
            return rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("v", F.lit(share), F.col("n"))).first()[0]
        else:
            rows, n, place = rows.where((v >= low) & (v <= high)), inside, place - below
    return rows.agg(F.percentile("v", F.lit(place / max(n - 1, 1)))).first()[0]


class Bins:
    """Consecutive bins [b0, b1), [b1, b2), ... of N ascending bounds.

    Values below the first bound belong to the first bin if ``left``, else to none
    (null); values from the last bound on to the last bin if ``right``, else to none.
    """

    def __init__(self, bounds: Sequence[float], left: bool = True, right: bool = True):
        bounds = [float(b) for b in bounds]
        if len(bounds) < 2 or any(not a < b for a, b in zip(bounds, bounds[1:], strict=False)):
            raise ValueError("bounds must be at least two and strictly ascending")
        self.bounds, self.left, self.right = bounds, left, right

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @classmethod
    def linear(cls, low: float, high: float, n: int, left: bool = True, right: bool = True, closed: bool = False) -> Bins:
        """n bins; a bound is (high - low) / (n + 1) after the one before, so the last falls short of ``high`` unless ``closed``."""
        step = (high - low) / (n if closed else n + 1)
        return cls([low + step * i for i in range(n + 1)], left, right)

    @classmethod
    def exponential(cls, base: float, low: float, high: float, n: int, left: bool = True, right: bool = True) -> Bins:
        """n bins with bounds base ** (low + i * (high - low) / n)."""
        step = (high - low) / n
        return cls([base ** (low + i * step) for i in range(n + 1)], left, right)

    @classmethod
    def quantiles(cls, df: DataFrame, column: str, at: Sequence[float], left: bool = True, right: bool = True) -> Bins:
        """Bounds at exact, linearly interpolated quantiles of a column."""
        got = exact_quantiles(df, {column: at})[column]
        if got is None:
            raise ValueError("no values to take quantiles of")
        return cls(got, left, right)

    @classmethod
    def n_quantiles(cls, df: DataFrame, column: str, n: int, left: bool = True, right: bool = True) -> Bins:
        """n bins at quantiles i / (n + 1), i from 0 to n: the highest values are beyond the last bound."""
        return cls.quantiles(df, column, cls.shares(n), left, right)

    @staticmethod
    def shares(n: int) -> list[float]:
        return [i / (n + 1) for i in range(n + 1)]

    @classmethod
    def inner(cls, bounds: Sequence[float]) -> Bins:
        """Bins between inner bounds, open to infinity at both ends."""
        return cls([float("-inf"), *bounds, float("inf")])

    def index(self, v: Column) -> Column:
        """The bin's number, from 0; null for a null value, NaN, or one beyond an end that doesn't snap."""
        n = len(self)
        reached = reduce(lambda a, b: a + b, [F.when(v >= F.lit(b), 1).otherwise(0) for b in self.bounds]) - 1
        low = F.lit(0 if self.left else None).cast("int")
        high = F.lit(n - 1 if self.right else None).cast("int")
        return F.when(v.isNull() | F.isnan(v.cast("double")), F.lit(None).cast("int")).when(reached < 0, low).when(reached >= n, high).otherwise(reached)


def upper_index(uppers: Sequence[float], v: Column) -> Column:
    """The other convention: N upper bounds make N bins, a value equal to a bound goes to the next, the last bin is open."""
    reached = reduce(lambda a, b: a + b, [F.when(v >= F.lit(float(b)), 1).otherwise(0) for b in uppers])
    return F.when(v.isNull() | F.isnan(v.cast("double")), F.lit(None).cast("int")).otherwise(F.least(F.lit(len(uppers) - 1), reached))


class Grid:
    """Bins in several dimensions; the linear index is row-major."""

    def __init__(self, *dims: Bins):
        self.dims = dims

    def __len__(self) -> int:
        return reduce(lambda a, b: a * b, [len(d) for d in self.dims], 1)

    def indexes(self, *values: Column) -> Column:
        return F.struct(*[d.index(v).alias(f"bin{i}") for i, (d, v) in enumerate(zip(self.dims, values, strict=True))])

    def out_of_range(self, *values: Column) -> Column:
        """The dimensions in which a value belongs to no bin, all of them."""
        return F.array_compact(F.array(*[F.when(d.index(v).isNull(), i) for i, (d, v) in enumerate(zip(self.dims, values, strict=True))]))

    def linear(self, *values: Column) -> Column:
        out = F.lit(0)
        for d, v in zip(self.dims, values, strict=True):
            out = out * len(d) + d.index(v)
        return out

    def counts(self, df: DataFrame, *values: Column) -> DataFrame:
        """cell, n for every cell, also empty ones; values in no cell don't count."""
        cells = df.sparkSession.range(len(self)).select(F.col("id").cast("int").alias("cell"))
        got = df.select(self.linear(*values).alias("cell")).where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return cells.join(got, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))


class ScoreTable:
    """Scores by distance and absolute dot product; both ends of both snap."""

    def __init__(self, dist: Sequence[float] | Bins, dot: Sequence[float] | Bins, cells: Sequence[float]):
        self.dist = dist if isinstance(dist, Bins) else Bins(dist)
        self.dot = dot if isinstance(dot, Bins) else Bins(dot)
        self.cells = [float(c) for c in cells]
        if len(self.cells) != len(self.dist) * len(self.dot):
            raise ValueError(f"{len(self.cells)} cells for {len(self.dist)} x {len(self.dot)} bins")

    @classmethod
    def from_rows(cls, dist: Sequence[float], dot: Sequence[float], rows: Sequence[Sequence[float]]) -> ScoreTable:
        if any(len(r) != len(dot) - 1 for r in rows):
            raise ValueError("every row needs a score for each dot bin")
        return cls(dist, dot, [c for r in rows for c in r])

    @property
    def grid(self) -> Grid:
        return Grid(self.dist, self.dot)

    def score(self, dist: Column, dot: Column) -> Column:
        """The score of a match as a Column."""
        return F.element_at(F.array(*[F.lit(c) for c in self.cells]), self.grid.linear(dist, dot) + 1)

    def arrays(self):
        """Inner bounds and cells for numpy: bins are counts of inner bounds that a value reaches."""
        import numpy as np

        return np.array(self.dist.bounds[1:-1]), np.array(self.dot.bounds[1:-1]), np.array(self.cells).reshape(len(self.dist), len(self.dot))

    def to_df(self, spark) -> DataFrame:
        """dist_bin, dist_lo, dist_hi, dot_bin, dot_lo, dot_hi, score."""
        a, b, n = self.dist.bounds, self.dot.bounds, len(self.dot)
        return spark.createDataFrame([(i // n, a[i // n], a[i // n + 1], i % n, b[i % n], b[i % n + 1], c) for i, c in enumerate(self.cells)], "dist_bin int, dist_lo double, dist_hi double, dot_bin int, dot_lo double, dot_hi double, score double")


class UpperTable:
    """Scores by upper bounds in both dimensions."""

    def __init__(self, dist: Sequence[float], dot: Sequence[float], cells: Sequence[float]):
        if len(cells) != len(dist) * len(dot):
            raise ValueError("cells and bounds don't match")
        self.dist, self.dot, self.cells = list(dist), list(dot), [float(c) for c in cells]

    def score(self, dist: Column, dot: Column) -> Column:
        at = upper_index(self.dist, dist) * len(self.dot) + upper_index(self.dot, dot)
        return F.element_at(F.array(*[F.lit(c) for c in self.cells]), at + 1)
