"""Row functions over points, tangents and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMMETRIES = ("arithmetic_mean", "geometric_mean", "harmonic_mean", "min", "max")


def centroids(points: DataFrame) -> DataFrame:
    """cloud_id, n_points, cx, cy, cz."""
    return points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n_points"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))


def centred(points: DataFrame) -> DataFrame:
    """Points less their cloud's centroid."""
    c = centroids(points).drop("n_points")
    return points.join(c, "cloud_id").select("cloud_id", "point_idx", (F.col("x") - F.col("cx")).alias("x"), (F.col("y") - F.col("cy")).alias("y"), (F.col("z") - F.col("cz")).alias("z"))


def dot(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    return ax * bx + ay * by + az * bz


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    x, y, z = ax - bx, ay - by, az - bz
    return F.sqrt(x * x + y * y + z * z)


def geometric_mean(a: Column, b: Column) -> Column:
    """Negative values and NaN count as zero."""
    some = lambda v: F.when(v > 0, F.nanvl(v, F.lit(0.0))).when(v.isNotNull(), F.lit(0.0))
    return F.sqrt(some(a) * some(b))


def harmonic_mean(a: Column, b: Column) -> Column:
    """Zero unless both are positive."""
    return F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(F.lit(2.0) / (F.lit(1.0) / a + F.lit(1.0) / b))


def combine(symmetry: str, a: Column, b: Column) -> Column:
    """One value of two directions; of a number and NaN, min and max give the number."""
    if symmetry == "arithmetic_mean":
        return (a + b) / 2
    if symmetry == "geometric_mean":
        return geometric_mean(a, b)
    if symmetry == "harmonic_mean":
        return harmonic_mean(a, b)
    if symmetry == "min":
        return F.least(a, b)
    if symmetry == "max":
        return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))
    raise ValueError(f"unknown symmetry {symmetry!r}; there are {', '.join(SYMMETRIES)}")


def scaled_dot(raw: Column, alpha_a: Column, alpha_b: Column) -> Column:
    """An absolute dot product weighted by both points' colinearity."""
    return raw * geometric_mean(alpha_a, alpha_b)


def rectified(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The same axis, with its first component other than zero positive."""
    sign = F.when((x < 0) | ((x == 0) & ((y < 0) | ((y == 0) & (z < 0)))), -1.0).otherwise(1.0)
    return x * sign, y * sign, z * sign


def interpolate(low: Column, high: Column, share: Column) -> Column:
    return (high - low) * share + low


def unit(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Scaled to length 1; an error for a vector without length."""
    n = F.sqrt(x * x + y * y + z * z)
    n = F.when(n > 0, n).otherwise(F.raise_error(F.lit("a tangent has no length")).cast("double"))
    return x / n, y / n, z / n


def augmented(points: DataFrame, shift: float, jitter: float, seed: int = 1991) -> DataFrame:
    """Clouds moved as a whole and point by point by normal noise, for benchmarks; the shift is a function of cloud and seed."""
    u = lambda salt: (F.pmod(F.xxhash64("cloud_id", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + F.lit(1)) / F.lit((1 << 30) + 1)
    normal = lambda k: F.sqrt(-2 * F.log(u(k))) * F.cos(F.lit(6.283185307179586) * u(k + 10))
    return points.select("cloud_id", "point_idx", *[(F.col(c) + normal(k) * shift + F.randn(seed + k) * jitter).alias(c) for k, c in enumerate("xyz")])
