"""Ready-made queries over an engine's collections."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .operators import geometry, vector
from .plans import nodes as N


def entity_by_label(engine: Engine, label: str) -> DataFrame:
    """All entities of a collection."""
    return engine.run(N.Select(table=N.Table(label)))


def entities_near_point(engine: Engine, table: str, x: float, y: float, z: float, radius: float) -> DataFrame:
    """Entities within a radius of a point, nearest first, with ``distance``."""
    r = geometry.check_radius(radius)
    return geometry.near_positions(engine.catalog.scan(table), (x, y, z)).where(F.col("distance") <= r)


def entities_within_radius(engine: Engine, table: str, center: tuple[float, float, float], radius: float, closed: bool = True) -> DataFrame:
    return geometry.within_radius(engine.catalog.scan(table), center, radius, closed)


def vector_similarity_search(engine: Engine, table: str, query: list[float], k: int, column: str | None = None, metric: str = "cosine", tie: str | None = None) -> DataFrame:
    """The k most similar entities."""
    return vector.knn(engine.catalog.scan(table), query, k, column, metric, tie)


def similarity_search_with_threshold(engine: Engine, table: str, query: list[float], threshold: float, column: str | None = None) -> DataFrame:
    return vector.similarity_search(engine.catalog.scan(table), query, threshold, column)


def traverse_relationship(engine: Engine, start_label: str, relationship: str, end_label: str | None = None, low: int = 1, high: int = 1) -> DataFrame:
    """Bindings a and b of paths along a relationship."""
    pattern = N.Pattern(N.NodePattern("a", start_label), N.EdgePattern("r", relationship, low, high), N.NodePattern("b", end_label))
    return engine.run(N.Select(traverse=(pattern,)))


def entities_by_property_range(engine: Engine, table: str, column: str, low: Any = None, high: Any = None) -> DataFrame:
    """Entities whose property lies in a closed range; None leaves a side open."""
    tests = [N.Binary(op, N.Col(column), N.Lit(v)) for op, v in ((">=", low), ("<=", high)) if v is not None]
    where = None
    for t in tests:
        where = t if where is None else N.Binary("and", where, t)
    return engine.run(N.Select(table=N.Table(table), where=where))


def aggregate_by_property(engine: Engine, table: str, group: str, function: str, column: str = "*", alias: str = "value") -> DataFrame:
    """One aggregate per value of a property."""
    arg: N.Expr = N.Star() if column == "*" else N.Col(column)
    items = (N.Item(N.Col(group)), N.Item(N.Call(function.upper(), (arg,)), alias))
    return engine.run(N.Select(items=items, table=N.Table(table), group=(N.Col(group),)))
