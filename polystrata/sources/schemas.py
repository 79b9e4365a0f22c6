"""Schema objects made by DDL: fields, types, scopes, extensibility."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError, close_names
from ..plans.nodes import FieldDef, SchemaStatement

# Field types and the Spark type of each.
FIELD_TYPES: dict[str, str] = {
    "STRING": "string", "INTEGER": "bigint", "INT": "bigint", "FLOAT": "double", "DOUBLE": "double", "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "TIMESTAMP": "timestamp",
    "DURATION": "interval day to second", "JSON": "variant", "BYTES": "binary", "REFERENCE": "string", "REF": "string", "EDGE": "string", "POSITION3D": "struct<x:double,y:double,z:double>", "EMBEDDING": "array<double>",
    "ARRAY": "array<string>", "MAP": "map<string,string>",
}


def spark_type(f: FieldDef) -> str:
    """Spark's type of a field; ARRAY(t) and MAP(t) take an inner type."""
    if f.type in ("ARRAY", "MAP") and f.argument:
        inner = FIELD_TYPES.get(f.argument.upper())
        if inner is None:
            raise SchemaError(f"unknown element type {f.argument}", close_names(f.argument, FIELD_TYPES))
        return f"array<{inner}>" if f.type == "ARRAY" else f"map<string,{inner}>"
    return FIELD_TYPES[f.type]


def kind_of(f: FieldDef) -> str:
    """regular, cascaded, calculated (a formula) or computed (a registered function)."""
    return "cascaded" if f.cascade else "regular" if f.formula is None else "computed" if f.computed else "calculated"


@dataclass
class Schema:
    """A collection's declared fields. CLOSED rejects other columns, TYPED keeps them only as declared, OPEN gathers them in a map."""

    name: str
    fields: dict[str, FieldDef] = field(default_factory=dict)
    extensibility: str = "OPEN"

    def struct(self) -> T.StructType:
        out = T.StructType()
        for f in self.fields.values():
            meta = {"scope": f.scope, "kind": kind_of(f)}
            out.add(f.name, T._parse_datatype_string(spark_type(f)), not f.required, meta)
        return out

    def conform(self, df: DataFrame) -> DataFrame:
        """``df`` with the declared columns, cast; what happens to others follows the extensibility."""
        extra = [c for c in df.columns if c not in self.fields]
        if extra and self.extensibility == "CLOSED":
            raise SchemaError(f"schema {self.name} is closed; it has no field {', '.join(extra)}", close_names(extra[0], self.fields))
        out: list[Column] = []
        for f in self.fields.values():
            if (f.cascade or f.formula) and f.name not in df.columns:
                continue
            kind = spark_type(f)
            value = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
            if f.required and f.name not in df.columns:
                raise SchemaError(f"schema {self.name} requires field {f.name}", close_names(f.name, df.columns))
            cast = F.parse_json(value.cast("string")) if kind == "variant" else value.cast(kind)
            if f.type == "EMBEDDING" and f.argument:
                cast = F.when(cast.isNull() | (F.size(cast) == int(f.argument)), cast).otherwise(F.raise_error(F.lit(f"{f.name} needs {f.argument} dimensions")).cast(kind))
            if f.required:
                cast = F.when(cast.isNotNull(), cast).otherwise(F.raise_error(F.lit(f"{f.name} is required")).cast(kind))
            out.append(cast.alias(f.name))
        if extra and self.extensibility == "OPEN":
            out.append(F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(f"`{c}`").cast("string")) for c in extra])).alias("_extra"))
        return df.select(*out)


class SchemaBook:
    """Declared schemas, and the DDL statements on them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.schemas = spark, {}

    def get(self, name: str) -> Schema:
        if name not in self.schemas:
            raise SchemaError(f"no schema {name}", close_names(name, self.schemas))
        return self.schemas[name]

    def _status(self, status: str, name: str) -> DataFrame:
        n = len(self.schemas[name].fields) if name in self.schemas else 0
        return self.spark.range(1).select(F.lit(status).alias("status"), F.lit(name).alias("collection"), F.lit(n).cast("long").alias("fields"))

    def run(self, s: SchemaStatement) -> DataFrame:
        """One row of status, or the fields for DESCRIBE."""
        if s.action == "create":
            if s.name in self.schemas:
                if s.flag:
                    return self._status("exists", s.name)
                raise SchemaError(f"schema {s.name} exists")
            names = [f.name for f in s.fields]
            if len(set(names)) < len(names):
                raise SchemaError("a field is declared twice")
            self.schemas[s.name] = Schema(s.name, {f.name: f for f in s.fields}, s.value or "OPEN")
            return self._status("created", s.name)
        if s.action == "drop":
            if s.name not in self.schemas and s.flag:
                return self._status("absent", s.name)
            self.get(s.name)
            del self.schemas[s.name]
            return self._status("dropped", s.name)
        schema = self.get(s.name)
        if s.action == "describe":
            return self.describe(schema, s.flag)
        fields = dict(schema.fields)
        if s.action == "add":
            if s.fields[0].name in fields:
                raise SchemaError(f"field {s.fields[0].name} exists")
            fields[s.fields[0].name] = s.fields[0]
        elif s.action == "modify":
            if s.fields[0].name not in fields:
                raise SchemaError(f"no field {s.fields[0].name}", close_names(s.fields[0].name, fields))
            fields[s.fields[0].name] = s.fields[0]
        elif s.action == "drop_field":
            if s.value not in fields:
                raise SchemaError(f"no field {s.value}", close_names(s.value or "", fields))
            del fields[s.value]
        self.schemas[s.name] = replace(schema, fields=fields, extensibility=s.value if s.action == "extensibility" else schema.extensibility)
        return self._status("altered", s.name)

    def describe(self, schema: Schema, detailed: bool) -> DataFrame:
        rows = [(k, f.name, f.type + (f"({f.argument})" if f.argument else ""), spark_type(f), f.required, f.scope, kind_of(f), f.cascade.function if f.cascade else None, schema.extensibility) for k, f in enumerate(schema.fields.values())]
        out = self.spark.createDataFrame(rows, "place int, field string, type string, spark_type string, required boolean, scope string, kind string, aggregation string, extensibility string")
        return out if detailed else out.select("field", "type", "required")
