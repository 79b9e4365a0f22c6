"""Validation before running: statement, semantic, expression and schema rules, with errors and warnings."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import close_names
from ..functions import scalars as S
from . import nodes as N

_GROUPINGS = ("ROLLUP", "CUBE", "GROUPING SETS")


@dataclass(frozen=True)
class Issue:
    kind: str
    message: str
    suggestions: tuple[str, ...] = ()


@dataclass
class Result:
    errors: list[Issue] = field(default_factory=list)
    warnings: list[Issue] = field(default_factory=list)
    metadata: dict[str, int] = field(default_factory=dict)

    @property
    def valid(self) -> bool:
        return not self.errors

    def error(self, kind: str, message: str, suggestions=()) -> None:
        self.errors.append(Issue(kind, message, tuple(suggestions)))

    def warn(self, kind: str, message: str) -> None:
        self.warnings.append(Issue(kind, message))


class Validator:
    """Checks a statement; ``schema`` (table -> columns) adds the schema rules.

    ``strict`` makes warnings errors; ``allow_ambiguous`` lets bare columns of
    several tables pass; ``require_aliases`` asks for an alias on each expression.
    """

    def __init__(self, schema: dict[str, list[str]] | None = None, strict: bool = False, allow_ambiguous: bool = False, require_aliases: bool = False, functions: list[str] | None = None):
        self.schema, self.strict, self.allow_ambiguous, self.require_aliases = schema, strict, allow_ambiguous, require_aliases
        self.functions = [f.upper() for f in functions or []]

    def check(self, s: N.Statement) -> Result:
        out = Result()
        match s:
            case N.Select():
                self._select(s, out)
            case N.Insert(table, columns, rows):
                self._table(table, out)
                self._twice(columns, "column", out)
                for r in rows:
                    if len(r) != len(columns):
                        out.error("arity", f"INSERT names {len(columns)} columns, a row has {len(r)} values")
                for c in columns:
                    self._column(N.Col(c), [table], out)
                for r in rows:
                    for e in r:
                        self._expression(e, [], out)
            case N.Update(table, sets, where):
                self._table(table, out)
                self._twice([c for c, _ in sets], "assignment", out)
                for c, e in sets:
                    self._column(N.Col(c), [table], out)
                    self._expression(e, [table], out)
                if where is None:
                    out.warn("missing_where", "UPDATE without WHERE changes every row")
                else:
                    self._condition(where, [table], out)
            case N.Delete(table, where):
                self._table(table, out)
                if where is None:
                    out.warn("missing_where", "DELETE without WHERE removes every row")
                else:
                    self._condition(where, [table], out)
            case N.SchemaStatement() | N.StreamStatement():
                self._twice([f.name for f in s.fields], "field", out)
        if self.strict:
            out.errors += out.warnings
        return out

    # -- phases -----------------------------------------------------------

    def _select(self, s: N.Select, out: Result) -> None:
        tables = [t for t in (s.table, *[j.table for j in s.joins]) if t]
        for t in tables:
            if t.select is not None:
                self._select(t.select, out)
            elif not s.traverse:
                self._table(t.name, out)
        labels = [t.label for t in tables]
        self._twice(labels, "table alias", out)
        self._twice([i.alias for i in s.items if i.alias], "alias", out)
        names = {t.label: t.name for t in tables if t.select is None}
        if s.traverse:
            names = {}
        scope = list(names.values())
        self._labels = names
        aliases = {i.alias for i in s.items if i.alias}
        if s.where is not None:
            if N.is_aggregate(s.where):
                out.error("aggregate", "WHERE takes no aggregate; use HAVING")
            self._condition(s.where, scope, out)
        if s.having is not None and not s.group:
            out.error("group_by", "HAVING needs GROUP BY")
        for j in s.joins:
            if j.on is not None:
                self._condition(j.on, scope, out)
        for i in s.items:
            self._expression(i.expr, scope, out)
            if self.require_aliases and not i.alias and not isinstance(i.expr, N.Col | N.Star):
                out.error("semantic", f"{N.output_name(i)} needs an alias")
        group: list[N.Expr] = []
        for g in s.group:  # the keys of ROLLUP, CUBE and GROUPING SETS
            parts = g.args if isinstance(g, N.Call) and g.name in _GROUPINGS else (g,)
            group += [k for x in parts for k in (x.items if isinstance(x, N.Array) else (x,))]
        for e in [*group, *[k.expr for k in s.order]]:
            if not (isinstance(e, N.Col) and e.name in aliases):
                self._expression(e, scope, out)
        if s.having is not None:
            self._expression(N.rewrite(s.having, lambda x: N.Lit(0) if isinstance(x, N.Col) and x.name in aliases else None), scope, out)
        grouped = bool(s.group) or any(N.is_aggregate(i.expr) for i in s.items)
        if grouped:
            keys = [*group, *[i.expr for i in s.items if i.alias and N.Col(i.alias) in group]]
            for i in s.items:
                self._grouped(i.expr, keys, out)
        if s.limit == 0:
            out.error("range", "LIMIT is over 0")
        if s.offset and s.limit is None:
            out.warn("offset_without_limit", "OFFSET without LIMIT reads everything after it")
        if s.limit is not None and s.limit > 1000 and any(isinstance(k.expr, N.Similarity) for k in s.order):
            out.warn("performance", "more than 1000 neighbours")
        if any(isinstance(i.expr, N.Star) for i in s.items) and s.joins:
            out.warn("style", "SELECT * over a join takes every column of every table")
        for p in s.traverse:
            if p.edge.high is not None and p.edge.low > p.edge.high:
                out.error("range", "a path's shortest length is over its longest")
        out.metadata.update(tables=len(tables), joins=len(s.joins), items=len(s.items), patterns=len(s.traverse))
        for _, u in s.unions:
            self._select(u, out)

    def _grouped(self, e: N.Expr, keys: list[N.Expr], out: Result) -> None:
        if e in keys or isinstance(e, N.Lit | N.Param | N.Over) or (isinstance(e, N.Call) and e.name in N.AGGREGATES):
            return
        if isinstance(e, N.Col) and any(isinstance(k, N.Col) and k.name == e.name for k in keys):
            return
        if isinstance(e, N.Col | N.Star):
            out.error("group_by", f"{N.output_name(N.Item(e)) if isinstance(e, N.Col) else '*'} is neither grouped nor aggregated")
            return
        for x in N.children(e):
            self._grouped(x, keys, out)

    def _condition(self, e: N.Expr, scope: list[str], out: Result) -> None:
        self._expression(e, scope, out)
        for x in N.walk(e):
            if isinstance(x, N.Binary) and x.op == "=" and isinstance(x.left, N.Lit) and x.left == x.right:
                out.warn("always_true", "a condition compares a literal with itself")

    def _expression(self, e: N.Expr, scope: list[str], out: Result) -> None:
        for x in N.walk(e):
            match x:
                case N.Col():
                    self._column(x, scope, out)
                case N.Call(name, args):
                    self._call(name, args, out)
                case N.Binary("/" | "%", _, N.Lit(0) | N.Lit(0.0)):
                    out.error("arithmetic", "division by zero")
                case N.SimilarTo(_, _, t) if not -1 <= t <= 1:
                    out.error("range", "THRESHOLD lies between -1 and 1")
                case N.Near(_, _, N.Lit(r)) if isinstance(r, int | float) and r <= 0:
                    out.error("range", "a radius is over 0")
                case N.Binary("and" | "or", a, b) if any(isinstance(y, N.Lit) and y.value is not None and not isinstance(y.value, bool) for y in (a, b)):
                    out.error("type", f"{x.op.upper()} takes conditions")

    def _call(self, name: str, args: tuple, out: Result) -> None:
        if name in N.AGGREGATES and any(N.is_aggregate(a) for a in args):
            out.error("aggregate", f"{name} holds another aggregate")
        bounds = S.arity(name)
        if bounds is None:
            if name not in self.functions:
                out.error("semantic", f"no function {name}", close_names(name, [*S.known_functions(), *self.functions]))
        elif not bounds[0] <= len(args) <= bounds[1]:
            out.error("arity", f"{name} takes {bounds[0]} to {bounds[1]} arguments, not {len(args)}")

    def _table(self, name: str, out: Result) -> None:
        if self.schema is not None and name not in self.schema:
            out.error("unknown_table", f"no table {name}", close_names(name, self.schema))

    def _column(self, c: N.Col, scope: list[str], out: Result) -> None:
        if self.schema is None or c.name.lower() == "origin":
            return
        names = getattr(self, "_labels", {})
        if c.table is not None:
            table = names.get(c.table, c.table)
            if table not in self.schema:
                if names and c.table not in names and not any(c.table in self.schema.get(t, []) for t in scope):
                    out.error("unknown_table", f"no table {c.table}", close_names(c.table, names))
                return
            owners = [table]
        else:
            owners = [t for t in scope if t in self.schema]
        have = [t for t in owners if c.name in self.schema[t]]
        if owners and not have:
            flat = [f"{label}_{col}" for label, t in names.items() for col in self.schema.get(t, [])]
            if c.name not in flat:
                out.error("unknown_column", f"no column {c.name}", close_names(c.name, [x for t in owners for x in self.schema[t]]))
        elif len(have) > 1 and c.table is None and not self.allow_ambiguous:
            out.error("ambiguous_column", f"column {c.name} is in {', '.join(have)}")

    @staticmethod
    def _twice(names, what: str, out: Result) -> None:
        for n in {n for n in names if list(names).count(n) > 1}:
            out.error("duplicate", f"{what} {n} occurs twice")
