"""A multi-paradigm query engine on Spark: relational, graph, vector, hyperbolic, cascade and temporal queries."""

from .builder import QueryBuilder
from .engine import Engine
from .errors import QueryError

__all__ = ["Engine", "QueryBuilder", "QueryError"]
