"""Vector and hyperbolic kernels as Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest argument of acosh: a point's distance to itself is acosh(1.00001), about 0.004472.
CLAMP = 1.0 + 1e-5
CONTAINED, INTERSECTING = 0.1, 1.0


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def checked(a: Column, b: Column) -> tuple[Column, Column]:
    """Both vectors as doubles; different lengths raise at run time."""
    same = F.size(a) == F.size(b)
    bad = F.raise_error(F.concat(F.lit("vector dimensions differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return doubles(a), F.when(same | a.isNull() | b.isNull(), doubles(b)).otherwise(bad.cast("array<double>"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    a, b = checked(a, b)
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector raises (division by zero)."""
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    a, b = checked(a, b)
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    a, b = checked(a, b)
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; two empty vectors give 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    a, b = checked(a, b)
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x == y, 0.0).otherwise(1.0)))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(doubles(a), lambda x: x / n)


def similarity(a: Column, b: Column, metric: str) -> Column:
    """Larger is closer: cosine, dot, jaccard as they are, distances d as 1 / (1 + d)."""
    if metric in ("cosine", "dot", "jaccard"):
        return {"cosine": cosine, "dot": dot, "jaccard": jaccard}[metric](a, b)
    return 1 / (1 + distance(a, b, metric))


def distance(a: Column, b: Column, metric: str) -> Column:
    """Smaller is closer: euclidean, manhattan, hamming as they are, 1 - s for cosine and jaccard, -dot."""
    if metric in ("euclidean", "manhattan", "hamming"):
        return {"euclidean": euclidean, "manhattan": manhattan, "hamming": hamming}[metric](a, b)
    if metric == "dot":
        return -dot(a, b)
    return 1 - similarity(a, b, metric)


def position(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def origin() -> Column:
    """The apex (1, 0, 0) of the hyperboloid."""
    return position(F.lit(1.0), F.lit(0.0), F.lit(0.0))


def hyperbolic(p: Column, q: Column, curvature: float = 1.0) -> Column:
    """Geodesic distance; x is the time-like coordinate."""
    inner = -p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]
    # greatest() skips NULL, and a missing position has no distance
    return F.when(inner.isNotNull(), F.sqrt(F.lit(curvature)) * F.acosh(F.greatest(-inner / F.lit(curvature), F.lit(CLAMP))))
