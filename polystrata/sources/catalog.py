"""Collections: registered DataFrames, files, entities; DML by replacement."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExecutionError, UndefinedReference, close_names
from .schemas import SchemaBook


@dataclass
class Entity:
    """One entity: id, properties, and optionally a position and an embedding."""

    id: str
    properties: dict[str, Any] = field(default_factory=dict)
    position: tuple[float, float, float] | None = None
    embedding: list[float] | None = None


class Catalog:
    """Names to DataFrames. Files are read when they are first scanned; nothing is cached."""

    def __init__(self, spark: SparkSession, missing_as_empty: bool = False):
        self.spark, self.missing_as_empty = spark, missing_as_empty
        self._tables: dict[str, DataFrame] = {}
        self._paths: dict[str, tuple[str, str, dict]] = {}
        self.schemas = SchemaBook(spark)

    # -- registration -----------------------------------------------------

    def register(self, name: str, df: DataFrame) -> None:
        self._tables[name] = df

    def register_files(self, name: str, path: str, format: str = "parquet", **options: Any) -> None:
        """A table of files (parquet, orc, csv, json, text)."""
        self._tables.pop(name, None)
        self._paths[name] = (path, format, options)

    def register_folder(self, path: str, names: Iterable[str], suffix: str = ".parquet") -> None:
        """``path/name.parquet`` for each name."""
        for n in names:
            self.register_files(n, f"{path}/{n}{suffix}")

    def add_entities(self, name: str, entities: Iterable[Entity]) -> None:
        """Add entities to a collection; columns are all properties seen, with NULL where an entity has none."""
        rows = list(entities)
        keys = list(dict.fromkeys(k for e in rows for k in e.properties))
        kinds = [T.StructField("id", T.StringType(), False)]
        for k in keys:
            sample = next((e.properties[k] for e in rows if e.properties.get(k) is not None), None)
            kinds.append(T.StructField(k, self._type_of(sample)))
        kinds += [T.StructField("position", T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])), T.StructField("embedding", T.ArrayType(T.DoubleType()))]
        data = [(e.id, *[self._value(e.properties.get(k)) for k in keys], e.position, e.embedding) for e in rows]
        df = self.spark.createDataFrame(data, T.StructType(kinds))
        self.register(name, self._tables[name].unionByName(df, allowMissingColumns=True) if name in self._tables else df)

    def add_entity(self, name: str, entity: Entity) -> None:
        self.add_entities(name, [entity])

    @staticmethod
    def _value(x: Any) -> Any:
        return float(x) if isinstance(x, float) else x

    @staticmethod
    def _type_of(x: Any) -> T.DataType:
        if isinstance(x, bool):
            return T.BooleanType()
        if isinstance(x, int):
            return T.LongType()
        if isinstance(x, float):
            return T.DoubleType()
        if isinstance(x, list):
            return T.ArrayType(Catalog._type_of(x[0]) if x else T.StringType())
        if isinstance(x, dict):
            return T.MapType(T.StringType(), Catalog._type_of(next(iter(x.values()), "")))
        return T.StringType()

    # -- reading ----------------------------------------------------------

    def names(self) -> list[str]:
        return sorted({*self._tables, *self._paths})

    def has(self, name: str) -> bool:
        return name in self._tables or name in self._paths

    def scan(self, name: str, kind: str | None = None) -> DataFrame:
        """A collection, or one entity type of it: the view ``name__type``, or rows of column ``_type``."""
        if kind and self.has(f"{name}__{kind}"):
            return self.scan(f"{name}__{kind}")
        if name in self._tables:
            df = self._tables[name]
        elif name in self._paths:
            path, fmt, options = self._paths[name]
            df = self.spark.read.format(fmt).options(**options).load(path)
            self._tables[name] = df
        elif self.missing_as_empty:
            return self.spark.createDataFrame([], "id string")
        else:
            raise UndefinedReference(f"no collection {name}", close_names(name, self.names()))
        return df.where(F.col("_type") == kind) if kind and "_type" in df.columns else df

    def scan_with_limit(self, name: str, n: int, kind: str | None = None) -> DataFrame:
        return self.scan(name, kind).limit(n)

    def count_entities(self, name: str) -> int:
        """Row count without reading columns (file footers suffice for parquet)."""
        return self.scan(name).count()

    # -- writing ----------------------------------------------------------

    def insert(self, name: str, columns: tuple[str, ...], rows: list[list[Column]]) -> DataFrame:
        """The table with the rows added; a new table if there is none. Columns not named are NULL."""
        one = self.spark.range(len(rows), numPartitions=1) if len(rows) == 1 else None
        structs = [F.struct(*[v.alias(c) for c, v in zip(columns, r, strict=True)]) for r in rows]
        base = one if one is not None else self.spark.range(1, numPartitions=1)
        added = base.select(F.inline(F.array(*structs)))
        if self.has(name):
            old = self.scan(name)
            extra = [c for c in columns if c not in old.columns]
            if extra:
                raise ExecutionError(f"{name} has no column {', '.join(extra)}", close_names(extra[0], old.columns))
            kinds = dict(old.dtypes)
            added = added.select(*[(F.col(f"`{c}`").cast(kinds[c]) if c in columns else F.lit(None).cast(kinds[c])).alias(c) for c in old.columns])
            added = old.unionByName(added)
        self.register(name, added)
        return added

    def update(self, name: str, sets: dict[str, Column], where: Column | None) -> DataFrame:
        """The table with new values in rows where ``where`` is true."""
        old = self.scan(name)
        kinds = dict(old.dtypes)
        for c in sets:
            if c not in kinds:
                raise ExecutionError(f"{name} has no column {c}", close_names(c, kinds))
        new = {c: (v if where is None else F.when(where, v).otherwise(F.col(f"`{c}`"))).cast(kinds[c]) for c, v in sets.items()}
        out = old.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in old.columns])
        self.register(name, out)
        return out

    def delete(self, name: str, where: Column | None) -> DataFrame:
        """The table without the rows where ``where`` is true; all rows without a condition."""
        old = self.scan(name)
        out = old.where(~F.coalesce(where, F.lit(False))) if where is not None else old.where(F.lit(False))
        self.register(name, out)
        return out

    def write(self, name: str, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
        """Sink: the collection as files."""
        writer = self.scan(name).write.format(format).mode(mode)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
