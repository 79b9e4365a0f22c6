"""Types of expressions, and mismatches, from column types alone."""

from __future__ import annotations

from ..errors import TypeMismatch
from . import nodes as N

# Columns whose type is known without a schema.
WELL_KNOWN = {"position": "point", "label": "string", "name": "string", "id": "entity_id", "created_at": "timestamp", "updated_at": "timestamp"}
_NUMERIC = {"integer", "float", "numeric"}
_TEXT = {"UPPER", "LOWER", "TRIM", "SUBSTRING", "SUBSTR", "CONCAT", "REPLACE", "STRING_AGG", "GROUP_CONCAT", "UUID"}
_FLOAT = {"SQRT", "EXP", "LOG", "LN", "POW", "POWER", "AVG", "STDDEV", "VARIANCE", "PI", "RAND", "HYPERBOLIC_DISTANCE", "GEODESIC_DISTANCE", "DOT_PRODUCT", "MAGNITUDE", "MEDIAN", "PERCENTILE"}
_INTEGER = {"COUNT", "LENGTH", "LEN", "FLOOR", "CEIL", "TIME_DIFF", "EXTRACT_TIME", "OCTET_LENGTH", "ROW_NUMBER", "RANK", "DENSE_RANK"}
_BOOLEAN = {"WITHIN_RADIUS", "IN_RADIUS", "CONTAINS", "INTERSECTS"}


def of_spark(name: str) -> str:
    """Checker type of a Spark type's name."""
    for prefix, kind in (("struct<x:", "point"), ("array", "list"), ("map", "map"), ("timestamp", "timestamp"), ("decimal", "float"), ("interval", "duration")):
        if name.startswith(prefix):
            return kind
    return {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "float", "float": "float", "string": "string", "boolean": "bool", "void": "null", "date": "date", "binary": "bytes"}.get(name, "unknown")


def infer(e: N.Expr, columns: dict[str, str] | None = None) -> str:
    """The type of an expression; raises where operands cannot go together. ``columns``: name -> checker type."""
    columns = columns or {}
    go = lambda x: infer(x, columns)
    match e:
        case N.Lit(v):
            return "null" if v is None else "bool" if isinstance(v, bool) else "integer" if isinstance(v, int) else "float" if isinstance(v, float) else "string"
        case N.Col(name):
            return columns.get(name, WELL_KNOWN.get(name, "unknown"))
        case N.Unary("not", x):
            _need(go(x), {"bool"}, "NOT")
            return "bool"
        case N.Unary(op, x):
            kind = go(x)
            _need(kind, _NUMERIC, op)
            return kind
        case N.Binary(op, left, right):
            a, b = go(left), go(right)
            if op in ("and", "or"):
                _need(a, {"bool"}, op.upper())
                _need(b, {"bool"}, op.upper())
                return "bool"
            if op in ("+", "-", "*", "/", "%"):
                if "timestamp" in (a, b) or "duration" in (a, b) or "date" in (a, b):
                    return "timestamp" if "timestamp" in (a, b) else "duration"
                _need(a, _NUMERIC, op)
                _need(b, _NUMERIC, op)
                return "float" if op == "/" or "float" in (a, b) else "integer" if a == b == "integer" else "numeric"
            known = {"unknown", "null"}
            time_like = {"timestamp", "date", "string"}
            if not ({a, b} & known or a == b or {a, b} <= _NUMERIC or {a, b} <= time_like or {a, b} <= {"string", "entity_id"}):
                raise TypeMismatch(f"cannot compare {a} with {b}")
            return "bool"
        case N.Between(x, low, high):
            go(N.Binary(">=", x, low)), go(N.Binary("<=", x, high))
            return "bool"
        case N.Like(x, pattern):
            _need(go(x), {"string", "entity_id"}, "LIKE")
            _need(go(pattern), {"string"}, "LIKE")
            return "bool"
        case N.InList(x, items):
            for i in items:
                go(N.Binary("=", x, i))
            return "bool"
        case N.IsNull() | N.Near() | N.SimilarTo() | N.Exists() | N.InSelect():
            return "bool"
        case N.Similarity() | N.DistanceFrom():
            return "float"
        case N.Array():
            return "list"
        case N.Case(whens, default):
            kinds = {go(v) for _, v in whens} | ({go(default)} if default is not None else set())
            kinds -= {"null", "unknown"}
            if len(kinds) > 1 and not kinds <= _NUMERIC:
                raise TypeMismatch(f"CASE gives {', '.join(sorted(kinds))}")
            return kinds.pop() if len(kinds) == 1 else "numeric" if kinds else "unknown"
        case N.Over(call):
            return go(call)
        case N.Call(name, args):
            for group, kind in ((_TEXT, "string"), (_FLOAT, "float"), (_INTEGER, "integer"), (_BOOLEAN, "bool")):
                if name in group:
                    return kind
            if name in ("ABS", "ROUND", "SUM", "SIGN") and args:
                _need(go(args[0]), _NUMERIC, name)
                return go(args[0])
            if name in ("NOW", "CURRENT_TIMESTAMP", "TIME_BUCKET", "DATE_TRUNC"):
                return "timestamp"
            return {"POSITION": "point", "VECTOR": "list", "NORMALIZE": "list"}.get(name, go(args[0]) if name in ("MIN", "MAX", "LAG", "LEAD", "COALESCE") and args else "unknown")
    return "unknown"


def _need(kind: str, allowed: set[str], what: str) -> None:
    if kind not in allowed | {"unknown", "null"}:
        raise TypeMismatch(f"{what} does not take {kind}")
