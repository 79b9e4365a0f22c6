"""Lowering of syntax trees to DataFrames. Catalyst plans and runs them; nothing here looks at rows."""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CompilationError, FunctionError, UndefinedReference, ValidationFailed, close_names
from ..functions import kernels as K
from ..functions import scalars as S
from . import nodes as N

if TYPE_CHECKING:
    from ..engine import Engine

_POSITION = "position"
_SERIAL = itertools.count()
#: Calls of GROUP BY that make several groupings at once.
_GROUPINGS = ("ROLLUP", "CUBE", "GROUPING SETS")


@dataclass
class Scope:
    """What names mean: (table label, column) -> column of the DataFrame."""

    df: DataFrame
    columns: dict[tuple[str, str], str]
    labels: list[str]
    outer: Scope | None = None
    names: list[str] = field(default_factory=list)
    lent: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.names = self.names or list(self.df.columns)

    def all_names(self) -> list[str]:
        return [*dict.fromkeys([c for _, c in self.columns]), *self.names]

    def lend(self, column: str) -> str:
        """A name for a column that a correlated subquery refers to; no other column has it."""
        if column not in self.lent:
            self.lent[column] = f"_outer{next(_SERIAL)}"
        return self.lent[column]

    def ready(self) -> DataFrame:
        """The DataFrame with the columns lent to subqueries."""
        return self.df.withColumns({new: F.col(f"`{c}`") for c, new in self.lent.items()}) if self.lent else self.df

    def find(self, name: str, table: str | None = None) -> str | None:
        if table is not None:
            hit = self.columns.get((table, name))
            # a struct field: position.x
            return hit
        found = list(dict.fromkeys(v for (_, c), v in self.columns.items() if c == name))
        if len(found) > 1:
            raise CompilationError(f"column {name} is ambiguous", [f"{t}.{c}" for t, c in self.columns if c == name])
        if found:
            return found[0]
        return name if name in self.names else None


def literal(value: Any) -> Column:
    """A Python value as a Column; lists of numbers are vectors."""
    if isinstance(value, list | tuple):
        return F.array(*[F.lit(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else F.lit(x) for x in value])
    if isinstance(value, dict) and set(value) == {"x", "y", "z"}:
        return K.position(F.lit(value["x"]), F.lit(value["y"]), F.lit(value["z"]))
    return value if isinstance(value, Column) else F.lit(value)


class Lowering:
    """Lowers one statement with the engine's catalog and bound parameters."""

    def __init__(self, engine: Engine, params: dict[str, Any]):
        self.engine, self.params = engine, params

    # -- expressions ------------------------------------------------------

    def col(self, e: N.Expr, scope: Scope) -> Column:
        """The Column of an expression."""
        go = functools.partial(self.col, scope=scope)
        match e:
            case N.Lit(value):
                return F.lit(value)
            case N.Param(name):
                if name not in self.params:
                    raise UndefinedReference(f"parameter {name} is not bound", close_names(name, self.params))
                return literal(self.params[name])
            case N.Col(name, table):
                return self._column(e, scope)
            case N.Unary("not", x):
                return ~go(x)
            case N.Unary(op, x):
                return -go(x) if op == "-" else go(x)
            case N.Binary(op, left, right):
                a, b = go(left), go(right)
                ops = {"+": a.__add__, "-": a.__sub__, "*": a.__mul__, "/": a.__truediv__, "%": a.__mod__, "=": a.__eq__, "!=": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__, "and": a.__and__, "or": a.__or__}
                return ops[op](b)
            case N.Between(x, low, high, negated):
                out = go(x).between(go(low), go(high))
                return ~out if negated else out
            case N.Like(x, N.Lit(pattern), negated):
                out = go(x).like(pattern)
                return ~out if negated else out
            case N.Like(x, pattern, negated):
                out = F.like(go(x), go(pattern))
                return ~out if negated else out
            case N.InList(x, items, negated):
                out = go(x).isin(*[go(i) for i in items]) if items else F.lit(False)
                return ~out if negated else out
            case N.InSelect(x, select, negated):
                out = go(x).isin(self.select(select, scope))
                return ~out if negated else out
            case N.IsNull(x, negated):
                return go(x).isNotNull() if negated else go(x).isNull()
            case N.Array(items):
                return F.array(*[go(i) for i in items])
            case N.Cast(x, kind):
                from ..sources.schemas import FIELD_TYPES

                return go(x).cast(FIELD_TYPES.get(kind.upper(), kind))
            case N.Case(whens, default):
                out = None
                for test, value in whens:
                    out = F.when(go(test), go(value)) if out is None else out.when(go(test), go(value))
                return out if default is None else out.otherwise(go(default))
            case N.Scalar(select):
                return self.select(select, scope).scalar()
            case N.Exists(select):
                return self.select(select, scope).exists()
            case N.Similarity(v, ref, metric, is_distance):
                return (K.distance if is_distance else K.similarity)(go(v), go(ref), metric)
            case N.SimilarTo(v, ref, threshold):
                if not -1 <= threshold <= 1:
                    raise ValidationFailed("THRESHOLD lies between -1 and 1")
                return K.cosine(go(v), go(ref)) >= F.lit(threshold)
            case N.Near(target, ref, radius):
                return K.hyperbolic(self.point(target, scope), self.point(ref, scope)) <= go(radius)
            case N.DistanceFrom(target, ref):
                return K.hyperbolic(self.point(target, scope), self.point(ref, scope))
            case N.Over():
                return self._over(e, scope)
            case N.Call():
                return self._call(e, scope)
            case N.Star():
                raise CompilationError("* stands only in SELECT and COUNT")
        raise CompilationError(f"cannot lower {type(e).__name__}")

    def _column(self, e: N.Col, scope: Scope) -> Column:
        hit = scope.find(e.name, e.table)
        if hit is not None:
            return F.col(f"`{hit}`")
        if scope.outer is not None and (e.table is None or e.table not in scope.labels):
            far = scope.outer.find(e.name, e.table)
            if far is not None:
                return F.col(scope.outer.lend(far)).outer()
        if e.table is not None:
            owner = scope.find(e.table)  # a field of a struct column
            if owner is not None:
                return F.col(f"`{owner}`").getField(e.name)
            if e.table not in scope.labels:
                raise UndefinedReference(f"no table {e.table}", close_names(e.table, scope.labels))
        if e.name.lower() == "origin" and e.table is None:
            return K.origin()
        raise UndefinedReference(f"no column {e.name}", close_names(e.name, scope.all_names()))

    def point(self, e: N.Expr, scope: Scope) -> Column:
        """A position: columns x, y, z stand in where there is no column ``position``."""
        if isinstance(e, N.Col) and e.name == _POSITION and scope.find(_POSITION, e.table) is None:
            parts = [scope.find(c, e.table) for c in "xyz"]
            if all(parts):
                return K.position(*[F.col(f"`{p}`") for p in parts])
        return self.col(e, scope)

    def _call(self, e: N.Call, scope: Scope) -> Column:
        name = e.name
        if name in S.AGGREGATES:
            return self._aggregate(e, scope)
        if name in S.SCALARS:
            (low, high), f = S.SCALARS[name]
            if not low <= len(e.args) <= high:
                raise FunctionError(f"{name} takes {low} to {high} arguments, not {len(e.args)}")
            position_args = name in ("HYPERBOLIC_DISTANCE", "GEODESIC_DISTANCE", "WITHIN_RADIUS", "IN_RADIUS", "CONTAINS", "INTERSECTS")
            return f(*[self.point(a, scope) if position_args and k < 2 else self.col(a, scope) for k, a in enumerate(e.args)])
        if self.engine.functions.has(name):
            return self.engine.functions.call(name, [self.col(a, scope) for a in e.args])
        raise FunctionError(f"no function {name}", close_names(name, [*S.known_functions(), *self.engine.functions.names()]))

    def _aggregate(self, e: N.Call, scope: Scope) -> Column:
        (low, high), f = S.AGGREGATES[e.name]
        if not low <= len(e.args) <= high:
            raise FunctionError(f"{e.name} takes {low} to {high} arguments, not {len(e.args)}")
        if e.name == "COUNT" and (not e.args or isinstance(e.args[0], N.Star)):
            return F.count(F.lit(1))
        args = [self.col(a, scope) for a in e.args]
        if e.name.startswith("VECTOR_"):
            row = scope.df.select(args[0].alias("v")).where("v IS NOT NULL").select(F.size("v")).head()
            # a group of vectors of another length is an error, not a shorter sum
            dims = row[0] if row else 0
            odd = F.count_if(F.size(args[0]) != dims) > 0
            wrong = F.raise_error(F.lit(f"{e.name} over vectors of different lengths")).cast("array<double>")
            return F.when(odd, wrong).otherwise(f(args[0], dims))
        if e.distinct:
            plain = {"COUNT": F.count_distinct, "SUM": F.sum_distinct}
            if e.name in plain:
                return plain[e.name](*args)
            if e.name == "ARRAY_AGG":
                return F.array_sort(F.collect_set(args[0]))
            if e.name in ("MIN", "MAX"):
                return f(*args)
            raise FunctionError(f"{e.name} takes no DISTINCT")
        return f(*args)

    def _over(self, e: N.Over, scope: Scope) -> Column:
        spec = Window.partitionBy(*[self.col(p, scope) for p in e.partition])
        if e.order:
            spec = spec.orderBy(*[self.sort_key(k, self.col(k.expr, scope)) for k in e.order])
        name, args, frame = e.call.name, e.call.args, e.frame
        if name == "MOVING_AVG":  # the last n rows
            if not isinstance(args[1], N.Lit):
                raise FunctionError("MOVING_AVG takes a column and a number of rows")
            frame, args, name = (-(int(args[1].value) - 1), 0), args[:1], "AVG"
        if frame:
            low = Window.unboundedPreceding if frame[0] is None else frame[0]
            high = Window.unboundedFollowing if frame[1] is None else frame[1]
            spec = spec.rangeBetween(low, high) if e.by_value else spec.rowsBetween(low, high)
        if name in S.WINDOWED:
            plain = [a.value if isinstance(a, N.Lit) else a for a in args[1:]]
            return S.WINDOWED[name](self.col(args[0], scope), *plain).over(spec)
        if name in S.RANKED:
            return S.RANKED[name]().over(spec)
        if name == "FIRST_VALUE":
            return F.first(self.col(args[0], scope)).over(spec)
        if name == "LAST_VALUE":
            return F.last(self.col(args[0], scope)).over(spec)
        if name in S.AGGREGATES:
            return self._aggregate(N.Call(name, args, e.call.distinct), scope).over(spec)
        raise FunctionError(f"{name} is no window function", close_names(name, [*S.WINDOWED, *S.RANKED, *S.AGGREGATES]))

    @staticmethod
    def sort_key(k: N.Key, c: Column) -> Column:
        if k.nulls_first is None:
            return c.desc() if k.descending else c.asc()
        if k.descending:
            return c.desc_nulls_first() if k.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if k.nulls_first else c.asc_nulls_last()

    # -- FROM -------------------------------------------------------------

    def table(self, t: N.Table) -> DataFrame:
        if t.select is not None:
            return self.select(t.select)
        df = self.engine.catalog.scan(t.name, t.type)
        kinds = dict(df.dtypes)
        if kinds.get(_POSITION, "").startswith("struct<x:") and not {"x", "y", "z"} & set(df.columns):
            df = df.withColumns({c: F.col(f"{_POSITION}.{c}") for c in "xyz"})  # positions are flattened as well
        return df

    def scope(self, s: N.Select, outer: Scope | None = None) -> Scope:
        out = self._scope(s)
        out.outer = outer
        return out

    def _scope(self, s: N.Select) -> Scope:
        if s.traverse:
            df = self.engine.graph.traverse(s.traverse, self, s.table.name if s.table else None)
            return Scope(df, {("", c): c for c in df.columns}, [])
        if s.table is None:
            return Scope(self.engine.spark.range(1).select(), {}, [])
        df = self.table(s.table)
        label = s.table.label
        labels = [label, *([s.table.name] if s.table.select is None else [])]
        if not s.joins:
            return Scope(df, {(lb, c): c for lb in labels for c in df.columns}, labels)
        out = df.select(*[F.col(f"`{c}`").alias(f"{label}_{c}") for c in df.columns])
        columns = {(label, c): f"{label}_{c}" for c in df.columns}
        for j in s.joins:
            other, label = self.table(j.table), j.table.label
            if any(label == t for t, _ in columns):
                raise CompilationError(f"table {label} is joined twice; give it an alias")
            mine = {(label, c): f"{label}_{c}" for c in other.columns}
            other = other.select(*[F.col(f"`{c}`").alias(f"{label}_{c}") for c in other.columns])
            if j.kind == "cross":
                out, columns = out.crossJoin(other), columns | mine
                continue
            clash = set(out.columns) & set(other.columns)
            if clash:
                raise CompilationError(f"column {clash.pop()} arises twice in the join; choose other aliases")
            both = Scope(_Names([*out.columns, *other.columns]), columns | mine, [t for t, _ in columns | mine])  # type: ignore[arg-type]
            on = self.col(j.on, both)
            out = out.join(other, on, {"semi": "left_semi", "anti": "left_anti"}.get(j.kind, j.kind))
            if j.kind not in ("semi", "anti"):
                columns |= mine
        return Scope(out, columns, list(dict.fromkeys(t for t, _ in columns)))

    # -- SELECT -----------------------------------------------------------

    def select(self, s: N.Select, outer: Scope | None = None) -> DataFrame:
        """``outer`` is the scope around a subquery, whose columns it may refer to."""
        if s.unions:
            return self._set_operations(s)
        scope = self.scope(s, outer)
        if s.where is not None:
            if N.is_aggregate(s.where):
                raise ValidationFailed("WHERE takes no aggregate; use HAVING")
            test = self.col(s.where, scope)
            scope.df = scope.ready().where(test)
        items = self._expand(s.items, scope)
        order, having = s.order, s.having
        aliases = {i.alias: i.expr for i in items if i.alias}
        grouped = bool(s.group) or having is not None or any(N.is_aggregate(i.expr) for i in items) or any(N.is_aggregate(k.expr) for k in order)
        if grouped:
            scope, items, having, order = self._group(s, scope, items, aliases)
            if having is not None:
                test = self.col(having, scope)
                scope.df = scope.ready().where(test)
        names = self._unique([N.output_name(i) for i in items])
        if s.distinct_on:
            scope.df = self._distinct_on(s, scope)
        outputs = [self.col(i.expr, scope).alias(n) for i, n in zip(items, names, strict=True)]
        if not order:
            df = scope.ready().select(*outputs)
            return self._limit(df.distinct() if s.distinct else df, s)
        keys, hidden = [], []
        for k in order:
            if isinstance(k.expr, N.Col) and k.expr.table is None and k.expr.name in names:
                keys.append((k, k.expr.name))
            elif isinstance(k.expr, N.Lit) and isinstance(k.expr.value, int) and 1 <= k.expr.value <= len(names):
                keys.append((k, names[k.expr.value - 1]))
            elif (same := next((n for i, n in zip(items, names, strict=True) if i.expr == k.expr), None)) is not None:
                keys.append((k, same))
            else:
                e = N.rewrite(k.expr, lambda x: aliases.get(x.name) if isinstance(x, N.Col) and x.table is None and scope.find(x.name) is None else None)
                hidden.append(self.col(e, scope).alias(f"_sort{len(hidden)}"))
                keys.append((k, f"_sort{len(hidden) - 1}"))
        if hidden and s.distinct:
            raise ValidationFailed("with DISTINCT, ORDER BY takes selected columns")
        df = scope.ready().select(*outputs, *hidden)
        df = df.distinct() if s.distinct else df
        df = df.orderBy(*[self.sort_key(k, F.col(f"`{n}`")) for k, n in keys])
        return self._limit(df.drop(*[f"_sort{k}" for k in range(len(hidden))]) if hidden else df, s)

    @staticmethod
    def _limit(df: DataFrame, s: N.Select) -> DataFrame:
        df = df.offset(s.offset) if s.offset else df
        return df.limit(s.limit) if s.limit is not None else df

    def _expand(self, items: tuple[N.Item, ...], scope: Scope) -> list[N.Item]:
        out: list[N.Item] = []
        for i in items:
            if not isinstance(i.expr, N.Star):
                out.append(i)
            elif i.expr.table is None:
                out += [N.Item(N.Col(c), c) for c in scope.names]
            else:
                mine = [(c, v) for (t, c), v in scope.columns.items() if t == i.expr.table]
                if not mine:
                    raise UndefinedReference(f"no table {i.expr.table}", close_names(i.expr.table, scope.labels))
                out += [N.Item(N.Col(c, i.expr.table), v) for c, v in mine]
        return out

    @staticmethod
    def _unique(names: list[str]) -> list[str]:
        out: list[str] = []
        for n in names:
            k, base = 1, n
            while n in out:
                k += 1
                n = f"{base}_{k}"
            out.append(n)
        return out

    def _group(self, s: N.Select, scope: Scope, items: list[N.Item], aliases: dict[str, N.Expr]):
        """One aggregation for all aggregates of SELECT, HAVING and ORDER BY; expressions over its output."""
        keys, several = [], None
        if len(s.group) == 1 and isinstance(s.group[0], N.Call) and s.group[0].name in _GROUPINGS:
            several = s.group[0]
        for g in self._flat_keys(several) if several else s.group:
            if isinstance(g, N.Col) and g.table is None and scope.find(g.name) is None and g.name in aliases:
                g = aliases[g.name]
            keys.append(g)
        key_cols = [self.col(g, scope) for g in keys]
        found: list[N.Call] = []

        def gather(e: N.Expr) -> None:
            if isinstance(e, N.Call) and e.name in S.AGGREGATES:
                if any(N.is_aggregate(a) for a in e.args):
                    raise ValidationFailed("aggregates cannot be nested")
                if e not in found:
                    found.append(e)
                return
            if not isinstance(e, N.Over):
                for x in N.children(e):
                    gather(x)

        deep = lambda e: N.rewrite(e, lambda x: aliases.get(x.name) if isinstance(x, N.Col) and x.table is None and x.name in aliases and scope.find(x.name) is None else None)
        having = deep(s.having) if s.having is not None else None
        order = tuple(N.Key(deep(k.expr), k.descending, k.nulls_first) if not (isinstance(k.expr, N.Col) and k.expr.name in aliases) else N.Key(aliases[k.expr.name], k.descending, k.nulls_first) for k in s.order)
        for e in [*[i.expr for i in items], *([having] if having is not None else []), *[k.expr for k in order]]:
            gather(e)
        resolved = [self._resolve(g, scope) for g in keys]
        aggs = [self._aggregate(a, scope).alias(f"_agg{k}") for k, a in enumerate(found)]
        named = [c.alias(f"_key{k}") for k, c in enumerate(key_cols)]
        names = [*[f"_key{k}" for k in range(len(named))], *[f"_agg{k}" for k in range(len(found))]]
        if several is not None:
            df = self._groupings(several, scope.ready(), keys, named, aggs or [F.count(F.lit(1)).alias("_n")])
        elif named and scope.outer is not None and scope.outer.lent:
            raise CompilationError("a correlated subquery takes no GROUP BY")
        elif named:
            df = scope.ready().groupBy(*named).agg(*aggs) if aggs else scope.ready().select(*named).distinct()
        else:  # a select of aggregates: unlike agg() it waits for the outer query's columns
            df = scope.ready().select(*(aggs or [F.count(F.lit(1)).alias("_n")]))
        new = Scope(df, {("", c): c for c in names}, [], scope.outer, names or ["_n"])

        def over_output(e: N.Expr) -> N.Expr | None:
            if isinstance(e, N.Call) and e in found:
                return N.Col(f"_agg{found.index(e)}")
            r = self._resolve(e, scope)
            if r in resolved:
                return N.Col(f"_key{resolved.index(r)}")
            if isinstance(e, N.Col) and not e.name.startswith(("_agg", "_key")) and e != N.Col("origin"):
                raise ValidationFailed(f"column {e.name} is neither grouped nor aggregated")
            return None

        out = [N.Item(N.rewrite(i.expr, over_output), N.output_name(i)) for i in items]
        having = N.rewrite(having, over_output) if having is not None else None
        return new, out, having, tuple(N.rewrite(k, over_output) for k in order)

    @staticmethod
    def _flat_keys(several: N.Call) -> list[N.Expr]:
        sets = several.args if several.name == "GROUPING SETS" else (N.Array(several.args),)
        return list(dict.fromkeys(k for group in sets for k in group.items))

    def _groupings(self, several: N.Call, df: DataFrame, keys: list[N.Expr], named: list[Column], aggs: list[Column]) -> DataFrame:
        """ROLLUP, CUBE or GROUPING SETS over the keys, which become columns first."""
        df = df.withColumns({f"_key{k}": c for k, c in enumerate(named)})
        cols = [F.col(f"_key{k}") for k in range(len(named))]
        if several.name == "GROUPING SETS":
            flat = self._flat_keys(several)
            sets = [[cols[flat.index(k)] for k in group.items] for group in several.args]
            return df.groupingSets(sets, *cols).agg(*aggs)
        return (df.rollup if several.name == "ROLLUP" else df.cube)(*cols).agg(*aggs)

    def _resolve(self, e: N.Expr, scope: Scope) -> N.Expr:
        """The expression with every column replaced by the DataFrame column it names."""
        return N.rewrite(e, lambda x: N.Col(hit) if isinstance(x, N.Col) and (hit := self._try_find(scope, x)) else None)

    @staticmethod
    def _try_find(scope: Scope, x: N.Col) -> str | None:
        try:
            return scope.find(x.name, x.table)
        except CompilationError:
            return None

    def _distinct_on(self, s: N.Select, scope: Scope) -> DataFrame:
        keys = [self.col(k, scope) for k in s.distinct_on]
        order = [self.sort_key(k, self.col(k.expr, scope)) for k in s.order] or [F.lit(1)]
        return scope.df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")

    def _set_operations(self, s: N.Select) -> DataFrame:
        from dataclasses import replace

        df = self.select(replace(s, unions=(), order=(), limit=None, offset=None))
        for kind, other in s.unions:
            right = self.select(other)
            if len(right.columns) != len(df.columns):
                raise ValidationFailed("set operations need as many columns on both sides")
            df = {"union": lambda a, b: a.union(b).distinct(), "union_all": lambda a, b: a.union(b), "intersect": lambda a, b: a.intersect(b), "intersect_all": lambda a, b: a.intersectAll(b), "except": lambda a, b: a.subtract(b), "except_all": lambda a, b: a.exceptAll(b)}[kind](df, right)
        scope = Scope(df, {("", c): c for c in df.columns}, [])
        if s.order:
            df = df.orderBy(*[self.sort_key(k, self.col(k.expr, scope)) for k in s.order])
        return self._limit(df, s)

    # -- other statements -------------------------------------------------

    def run(self, s: N.Statement) -> DataFrame:
        catalog = self.engine.catalog
        match s:
            case N.Select():
                return self.select(s)
            case N.Insert(table, columns, rows):
                none = Scope(self.engine.spark.range(1), {}, [])
                return catalog.insert(table, columns, [[self.col(v, none) for v in r] for r in rows])
            case N.Update(table, sets, where):
                scope = self._of(table)
                return catalog.update(table, {c: self.col(v, scope) for c, v in sets}, None if where is None else self.col(where, scope))
            case N.Delete(table, where):
                return catalog.delete(table, None if where is None else self.col(where, self._of(table)))
            case N.SchemaStatement():
                return catalog.schemas.run(s)
            case N.StreamStatement():
                none = Scope(self.engine.spark.range(1), {}, [])
                return self.engine.streams.run(s, [[self.col(v, none) for v in r] for r in s.rows])
        raise CompilationError(f"cannot run {type(s).__name__}")

    def _of(self, table: str) -> Scope:
        df = self.engine.catalog.scan(table)
        return Scope(df, {(table, c): c for c in df.columns}, [table])


class _Names:
    """Stands in for a DataFrame that is not there yet: only its column names."""

    def __init__(self, columns: list[str]):
        self.columns = columns
