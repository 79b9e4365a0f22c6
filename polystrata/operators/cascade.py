"""Cascades: measures gathered from a node's neighbours along relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExecutionError
from ..plans.nodes import Cascade

# Aggregation names, with the spellings that mean the same.
FUNCTIONS = {"SUM": "sum", "AVERAGE": "avg", "AVG": "avg", "MAX": "max", "MIN": "min", "COUNT": "count", "WEIGHTEDAVG": "weighted", "WEIGHTEDAVERAGE": "weighted", "LATEST": "latest", "FIRST": "first", "MOVINGMEAN": "mean_since", "MOVINGMEDIAN": "median_since", "TIMEWINDOWEDAVERAGE": "mean_since", "PERCENTILE": "percentile"}


def decay_weight(kind: str | None, rate: float, age: Column) -> Column:
    """Weight of a value of an age: exp(-a t), (1 + t)^-a, or max(0, 1 - a t)."""
    a = F.lit(float(rate))
    if kind in (None, "NONE"):
        return F.lit(1.0)
    if kind == "EXPONENTIAL":
        return F.exp(-a * age)
    if kind == "POWERLAW":
        return F.pow(1 + age, -a)
    return F.greatest(F.lit(0.0), 1 - a * age)


def gather(edges: DataFrame, nodes: DataFrame, spec: Cascade, out_col: str, id_col: str = "id", timestamp: str | None = None, now: Column | None = None, weight: str | None = None, unit_seconds: float = 86400.0) -> DataFrame:
    """(id, out_col): the aggregate of ``spec.source`` over each node's neighbours.

    INCOMING gathers from the tails of edges that point to the node, OUTGOING
    from the heads of its own edges.  ``timestamp`` is a column of the edges;
    ages are counted in days from ``now`` (the latest timestamp without it).
    One shuffle on the neighbour and one on the node; values combine on the map side.
    """
    kind = FUNCTIONS.get(spec.function)
    if kind is None:
        raise ExecutionError(f"unknown aggregation {spec.function}")
    if spec.through:
        edges = edges.where(F.col("type").isin(list(spec.through)))
    ts = F.unix_micros(F.col(timestamp).cast("timestamp")) / 1e6 if timestamp else None
    needs_time = kind in ("latest", "first", "mean_since", "median_since") or spec.decay not in (None, "NONE")
    if needs_time and ts is None:
        raise ExecutionError(f"{spec.function} needs a timestamp")
    extra = [*([ts.alias("_ts")] if ts is not None else []), *([F.col(weight).cast("double").alias("_w")] if weight else [])]
    to_node = edges.select(F.col("to_id").alias("_node"), F.col("from_id").alias("_other"), *extra)
    from_node = edges.select(F.col("from_id").alias("_node"), F.col("to_id").alias("_other"), *extra)
    ends = to_node if spec.direction == "INCOMING" else from_node if spec.direction == "OUTGOING" else to_node.unionByName(from_node)
    if needs_time:
        end = F.unix_micros(now.cast("timestamp")) / 1e6 if now is not None else F.lit(ends.agg(F.max("_ts")).first()[0])
        ends = ends.withColumn("_age", (end - F.col("_ts")) / unit_seconds)
        if kind in ("mean_since", "median_since"):
            ends = ends.where(F.col("_age").between(0, spec.argument or 0))
    rows = ends.join(nodes.select(F.col(id_col).alias("_other"), F.col(spec.source).alias("_v")), "_other")
    v = F.col("_v").cast("double") if kind not in ("count", "latest", "first", "min", "max") else F.col("_v")
    w = decay_weight(spec.decay, spec.rate, F.col("_age")) if spec.decay not in (None, "NONE") else F.lit(1.0)
    if weight:
        w = w * F.col("_w")
    agg = {
        "sum": lambda: F.sum(v * w),
        "avg": lambda: F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))),
        "mean_since": lambda: F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))),
        "weighted": lambda: F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))),
        "median_since": lambda: F.median(v),
        "max": lambda: F.max(v),
        "min": lambda: F.min(v),
        "count": lambda: F.count(v),
        # of equal timestamps the largest (latest) or smallest (first) value counts
        "latest": lambda: F.max_by(v, F.struct("_ts", v)),
        "first": lambda: F.min_by(v, F.struct("_ts", v)),
        "percentile": lambda: F.percentile(v, F.lit((spec.argument or 0) / 100)),
    }[kind]()
    return rows.groupBy(F.col("_node").alias("id")).agg(agg.alias(out_col))


def propagate(edges: DataFrame, nodes: DataFrame, source: str, levels: int, rate: float = 1.0, direction: str = "INCOMING", id_col: str = "id") -> DataFrame:
    """(id, value): own value plus that of nodes up to ``levels`` edges away, times ``rate`` per edge (all paths count)."""
    value = nodes.select(F.col(id_col).alias("id"), F.col(source).cast("double").alias("v"))
    total, wave = value, value
    a, b = ("from_id", "to_id") if direction == "INCOMING" else ("to_id", "from_id")
    steps = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    for _ in range(levels):
        wave = steps.join(wave, steps["src"] == wave["id"]).groupBy(F.col("dst").alias("id")).agg((F.sum("v") * F.lit(float(rate))).alias("v"))
        total = total.unionByName(wave)
    return total.groupBy("id").agg(F.sum("v").alias("value"))


def converge(edges: DataFrame, nodes: DataFrame, source: str, rate: float = 0.5, tolerance: float = 1e-6, most: int = 200, direction: str = "INCOMING", id_col: str = "id") -> DataFrame:
    """(id, value): influence, own value plus ``rate`` times the mean of the neighbours' influence, until no value moves by ``tolerance``.

    Rounds shrink changes by ``rate`` (under 1), so they end; ``most`` rounds without an end raise.
    """
    from .graph import settle

    if not 0 <= rate < 1:
        raise ExecutionError("the rate lies in [0, 1)")
    a, b = ("from_id", "to_id") if direction == "INCOMING" else ("to_id", "from_id")
    steps = settle(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct())
    own = settle(nodes.select(F.col(id_col).alias("id"), F.coalesce(F.col(source).cast("double"), F.lit(0.0)).alias("own")))
    held = own.withColumn("value", F.col("own"))
    for _ in range(most):
        got = steps.join(held, steps["src"] == held["id"]).groupBy("dst").agg(F.avg("value").alias("got"))
        new = held.join(got, held["id"] == got["dst"], "left").select("id", "own", F.col("value").alias("old"), (F.col("own") + F.lit(float(rate)) * F.coalesce("got", F.lit(0.0))).alias("value"))
        new = settle(new)
        moved = new.agg(F.max(F.abs(F.col("value") - F.col("old")))).first()[0] or 0.0
        held = new.drop("old")
        if moved < tolerance:
            return held.select("id", "value")
    raise ExecutionError(f"values still move after {most} rounds")


def distribute(edges: DataFrame, nodes: DataFrame, source: str, id_col: str = "id") -> DataFrame:
    """(id, value): each node's value shared equally among the heads of its edges."""
    degree = edges.groupBy("from_id").agg(F.count(F.lit(1)).alias("d"))
    rows = edges.join(degree, "from_id").join(nodes.select(F.col(id_col).alias("from_id"), F.col(source).cast("double").alias("v")), "from_id")
    return rows.groupBy(F.col("to_id").alias("id")).agg(F.sum(F.col("v") / F.col("d")).alias("value"))
