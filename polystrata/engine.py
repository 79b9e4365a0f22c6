"""The engine: collections, query text, builders, graph, streams and functions over one SparkSession."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .builder import QueryBuilder
from .errors import ValidationFailed
from .functions.registry import FunctionRegistry
from .operators.cascade import FUNCTIONS, gather
from .operators.graph import Graph
from .plans import nodes as N
from .plans.grammar import parse
from .plans.lower import Lowering, Scope
from .plans.typecheck import infer, of_spark
from .plans.validate import Result, Validator
from .sources.catalog import Catalog, Entity
from .sources.schemas import spark_type
from .streaming.streams import Streams


@dataclass
class Metadata:
    """What a statement touches, and a rough cost (rows and steps, for comparison only)."""

    kind: str
    tables: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    paradigms: list[str] = field(default_factory=list)
    operations: list[str] = field(default_factory=list)
    cost: float = 0.0


class Engine:
    """Runs query text and builders as DataFrames; everything is lazy until an action."""

    def __init__(self, spark: SparkSession, edge_table: str = "relationships", hop_cap: int = 10, undirected_arrows: bool = False, missing_as_empty: bool = False):
        self.spark = spark
        self.catalog = Catalog(spark, missing_as_empty)
        self.functions = FunctionRegistry(spark)
        self.graph = Graph(self, edge_table, hop_cap, undirected_arrows)
        self.streams = Streams(self)

    # -- data -------------------------------------------------------------

    def register(self, name: str, df: DataFrame) -> Engine:
        self.catalog.register(name, df)
        return self

    def load_folder(self, path: str, names: Iterable[str]) -> Engine:
        """Register ``path/name.parquet`` for each name."""
        self.catalog.register_folder(path, names)
        return self

    def add_entities(self, name: str, entities: Iterable[Entity]) -> Engine:
        self.catalog.add_entities(name, entities)
        return self

    def with_cascades(self, name: str, timestamp: str | None = None, now: Column | None = None, weight: str | None = None, source: str | None = None, id_col: str = "id") -> DataFrame:
        """A collection with the cascaded fields of its schema, gathered along the edge table.

        Values come from the collection ``source`` (its own without one). Each field is one aggregation over the edges.
        """
        out = self.catalog.scan(name)
        nodes = self.catalog.scan(source) if source else out
        edges = self.catalog.scan(self.graph.edge_table)
        for f in self.catalog.schemas.get(name).fields.values():
            if f.cascade is None:
                continue
            timed = f.cascade.decay not in (None, "NONE") or FUNCTIONS[f.cascade.function] in ("latest", "first", "mean_since", "median_since")
            weighted = weight if FUNCTIONS[f.cascade.function] == "weighted" else None
            got = gather(edges, nodes, f.cascade, f.name, id_col, timestamp if timed else None, now, weighted)
            out = out.drop(f.name).join(got.withColumnRenamed("id", "_cascade_id"), out[id_col] == F.col("_cascade_id"), "left").drop("_cascade_id")
        return out

    def with_calculated(self, name: str) -> DataFrame:
        """A collection with the calculated and computed fields of its schema, in the order of their declaration."""
        out = self.catalog.scan(name)
        for f in self.catalog.schemas.get(name).fields.values():
            if f.formula is not None:
                scope = Scope(out, {(name, c): c for c in out.columns}, [name])
                out = out.withColumn(f.name, Lowering(self, {}).col(f.formula, scope).cast(spark_type(f)))
        return out

    # -- queries ----------------------------------------------------------

    def sql(self, text: str, validate: bool = False, **params: Any) -> DataFrame:
        """Run one statement; ``@name`` and ``$name`` take ``params``."""
        return self.run(parse(text), validate, **params)

    def run(self, statement: N.Statement, validate: bool = False, **params: Any) -> DataFrame:
        if validate:
            found = self.validate(statement)
            if not found.valid:
                raise ValidationFailed("; ".join(i.message for i in found.errors), found.errors[0].suggestions)
        return Lowering(self, params).run(statement)

    def builder(self) -> QueryBuilder:
        return QueryBuilder(self)

    def explain(self, text: str, mode: str = "formatted", **params: Any) -> str:
        """Spark's plan of a statement."""
        df = self.sql(text, **params)
        return self.spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    # -- checks -----------------------------------------------------------

    def validate(self, statement: N.Statement | str, schema: dict[str, list[str]] | None = None, **options: Any) -> Result:
        s = parse(statement) if isinstance(statement, str) else statement
        return Validator(schema, functions=self.functions.names(), **options).check(s)

    def check_types(self, text: str) -> dict[str, str]:
        """Output types of a SELECT over one table; raises on mismatches."""
        s = parse(text)
        if not isinstance(s, N.Select):
            raise ValidationFailed("types are checked for SELECT")
        columns: dict[str, str] = {}
        for t in [s.table, *[j.table for j in s.joins]] if s.table else []:
            if t.select is None:
                columns |= {c: of_spark(k) for c, k in self.catalog.scan(t.name, t.type).dtypes}
        if s.where is not None and infer(s.where, columns) not in ("bool", "unknown", "null"):
            raise ValidationFailed("WHERE takes a condition")
        return {N.output_name(i): infer(i.expr, columns) for i in s.items if not isinstance(i.expr, N.Star)}

    def metadata(self, text: str) -> Metadata:
        """Tables, columns, paradigms and a rough cost of a statement."""
        s = parse(text)
        out = Metadata(type(s).__name__.lower())
        if isinstance(s, N.Insert | N.Update | N.Delete):
            out.tables, out.cost = [s.table], 100.0
        if isinstance(s, N.Select):
            self._describe(s, out)
        for name in ("tables", "columns", "paradigms", "operations"):
            setattr(out, name, list(dict.fromkeys(getattr(out, name))))
        return out

    def _describe(self, s: N.Select, out: Metadata) -> None:
        rows = 1000.0
        for t in [s.table, *[j.table for j in s.joins]]:
            if t is not None and t.select is not None:
                self._describe(t.select, out)
            elif t is not None:
                out.tables.append(t.name)
                out.operations.append("scan")
                out.cost += rows
        out.paradigms.append("relational")
        parts = [i.expr for i in s.items] + [e for e in (s.where, s.having) if e is not None] + list(s.group) + [k.expr for k in s.order] + [j.on for j in s.joins if j.on is not None]
        for e in parts:
            for x in N.walk(e):
                if isinstance(x, N.Col):
                    out.columns.append(x.name)
                elif isinstance(x, N.Similarity | N.SimilarTo):
                    out.paradigms.append("vector")
                elif isinstance(x, N.Near | N.DistanceFrom) or (isinstance(x, N.Call) and x.name in ("HYPERBOLIC_DISTANCE", "WITHIN_RADIUS", "IN_RADIUS", "GEODESIC_DISTANCE")):
                    out.paradigms.append("geometric")
                elif isinstance(x, N.Over):
                    out.paradigms.append("temporal")
        if s.traverse:
            out.paradigms.append("graph")
            out.operations.append("traverse")
            out.cost += 10 * rows * sum((p.edge.high or self.graph.cap) for p in s.traverse)
        if s.joins:
            out.operations.append("join")
            out.cost += 2 * rows * len(s.joins)
        if s.where is not None:
            out.operations.append("filter")
            rows /= 2
        if s.group or any(N.is_aggregate(i.expr) for i in s.items):
            out.operations.append("aggregate")
            out.cost += rows
            rows /= 10
        if s.order:
            out.operations.append("topk" if s.limit is not None else "sort")
            out.cost += rows * (1 if s.limit is not None else 3)
        if s.limit is not None:
            out.operations.append("limit")
