"""Hyperbolic operators on rows with a position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GeometricError
from ..functions import kernels as K


def position_of(df: DataFrame) -> Column:
    """Columns x, y, z, or else the struct ``position``."""
    if {"x", "y", "z"} <= set(df.columns):
        flat = K.position(F.col("x"), F.col("y"), F.col("z"))
        has = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
        return F.coalesce(F.when(has, flat), F.col("position")) if "position" in df.columns else F.when(has, flat)
    if "position" in df.columns:
        return F.col("position")
    raise GeometricError("no position: neither x, y, z nor position")


def point(p: tuple[float, float, float] | Column) -> Column:
    return K.position(*[F.lit(float(v)) for v in p]) if isinstance(p, tuple | list) else p


def check_radius(r: float) -> float:
    if not (math.isfinite(r) and r > 0):
        raise GeometricError("a radius is finite and over 0")
    return float(r)


def hyperbolic_distance(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.withColumn("distance", K.hyperbolic(a, b))


geodesic_distance = hyperbolic_distance


def within_radius(df: DataFrame, center, radius: float, closed: bool = True) -> DataFrame:
    """Rows in the ball with ``distance_from_center``; rows without a position go."""
    r = check_radius(radius)
    p = position_of(df)
    out = df.where(p.isNotNull()).withColumn("distance_from_center", K.hyperbolic(p, point(center)))
    return out.where(F.col("distance_from_center") <= r if closed else F.col("distance_from_center") < r)


def near_positions(df: DataFrame, reference, limit: int | None = None, tie: str | None = None) -> DataFrame:
    """Rows by distance to the reference, nearest first."""
    p = position_of(df)
    out = df.where(p.isNotNull()).withColumn("distance", K.hyperbolic(p, point(reference))).orderBy("distance", *([tie] if tie else []))
    return out if limit is None else out.limit(limit)


def contains(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows whose positions are closer than 0.1, with ``is_contained`` and ``containment_distance``."""
    out = df.withColumn("containment_distance", K.hyperbolic(a, b)).where(F.col("containment_distance") < K.CONTAINED)
    return out.withColumn("is_contained", F.lit(True))


def intersects(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows whose positions are closer than 1.0, with ``intersects`` and ``intersection_distance``."""
    out = df.withColumn("intersection_distance", K.hyperbolic(a, b)).where(F.col("intersection_distance") < K.INTERSECTING)
    return out.withColumn("intersects", F.lit(True))


def in_rectangle(df: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Rows in an axis-parallel box."""
    p = position_of(df)
    test = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        test = test & p[c].between(float(a), float(b))
    return df.where(test)


def in_polygon(df: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Rows whose (y, z) lies in a polygon, by crossings of a ray."""
    p = position_of(df)
    crossings = F.lit(0)
    for (y1, z1), (y2, z2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if z1 == z2:
            continue
        spans = (F.lit(float(z1)) > p["z"]) != (F.lit(float(z2)) > p["z"])
        at = (y2 - y1) * (p["z"] - z1) / (z2 - z1) + y1
        crossings = crossings + F.when(spans & (p["y"] < at), 1).otherwise(0)
    return df.where(crossings % 2 == 1)


def proximity_join(a: DataFrame, b: DataFrame, ids: tuple[str, str], radius: float) -> DataFrame:
    """(left_id, right_id, distance): pairs at most ``radius`` apart, exactly and without a cross join.

    For points of the hyperboloid acosh(x) is the distance to the apex, and two
    points' distances to it differ by at most their distance.  Rows meet in rings of
    width ``radius``, cut into sectors: seen from the apex, a point at distance d of
    it and one at most r away from that differ by an angle of at most
    asin(sinh r / sinh d).  The right side is in its ring and both neighbours, there
    in its sector and both neighbours.
    """
    r = check_radius(radius)
    width = r + 1e-9
    ring = lambda p: F.floor(F.acosh(F.greatest(p["x"], F.lit(1.0))) / F.lit(width))
    # rings 0 and 1 are one sector; the number of sectors of a ring follows from its inner edge
    reach = lambda k: F.asin(F.least(F.lit(1.0), F.lit(math.sinh(width)) / F.sinh(k * F.lit(width)))) + F.lit(1e-9)
    sectors = lambda k: F.when(k < 2, F.lit(1).cast("long")).otherwise(F.greatest(F.lit(1), F.floor(F.lit(2 * math.pi) / reach(k))))
    angle = lambda p: F.atan2(p["z"], p["y"]) + F.lit(math.pi)
    sector = lambda p, n: F.least(F.floor(angle(p) / F.lit(2 * math.pi) * n), n - 1)
    left = a.select(F.col(ids[0]).alias("left_id"), position_of(a).alias("_p"))
    right = b.select(F.col(ids[1]).alias("right_id"), position_of(b).alias("_q"))
    left = left.withColumn("_ring", ring(F.col("_p"))).withColumn("_sector", sector(F.col("_p"), sectors(F.col("_ring"))))
    right = right.withColumn("_at", ring(F.col("_q"))).withColumn("_ring", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1)))
    right = right.withColumn("_n", sectors(F.col("_ring"))).withColumn("_own", sector(F.col("_q"), F.col("_n")))
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.pmod(F.col("_own") + s, F.col("_n"))))
    right = right.withColumn("_sector", F.explode(near)).drop("_own", "_n")
    out = left.join(right, ["_ring", "_sector"]).withColumn("distance", K.hyperbolic(F.col("_p"), F.col("_q")))
    return out.where(F.col("distance") <= r).select("left_id", "right_id", "distance")
