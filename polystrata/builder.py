"""Fluent builder: makes the same syntax tree as query text."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING, Any

from .errors import ValidationFailed
from .plans import nodes as N
from .plans.grammar import Parser

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from .engine import Engine


def _expression(text: str | N.Expr) -> N.Expr:
    if not isinstance(text, str):
        return text
    p = Parser(text)
    out = p.expr()
    if p.tok.kind != "end":
        p.fail("unexpected text after the expression")
    return out


def _item(text: str) -> N.Item:
    p = Parser(text)
    out = p.item()
    if p.tok.kind != "end":
        p.fail("unexpected text after the column")
    return out


class QueryBuilder:
    """Collects clauses and errors; :meth:`build` gives the statement or raises all errors."""

    def __init__(self, engine: Engine | None = None):
        self._engine, self._errors = engine, []
        self._items: list[N.Item] = []
        self._select = N.Select()
        self._where: list[N.Expr] = []

    def _change(self, **parts: Any) -> QueryBuilder:
        self._select = replace(self._select, **parts)
        return self

    def _try(self, f, text):
        try:
            return f(text)
        except Exception as e:
            self._errors.append(str(e))
            return None

    def select(self, *columns: str) -> QueryBuilder:
        self._items += [i for c in columns if (i := self._try(_item, c)) is not None]
        return self

    def from_(self, table: str, alias: str | None = None) -> QueryBuilder:
        if not table:
            self._errors.append("FROM needs a table")
            return self
        name, _, kind = table.partition(".")
        return self._change(table=N.Table(name, kind or None, alias))

    def join(self, table: str, on: str, kind: str = "inner", alias: str | None = None) -> QueryBuilder:
        e = self._try(_expression, on)
        if e is not None:
            self._change(joins=(*self._select.joins, N.Join(kind, N.Table(table, None, alias), e)))
        return self

    def where_eq(self, column: str, value: Any) -> QueryBuilder:
        e = self._try(_expression, column)
        if e is not None:
            self._where.append(N.Binary("=", e, N.Lit(value)))
        return self

    def where_expr(self, condition: str | N.Expr) -> QueryBuilder:
        e = self._try(_expression, condition)
        if e is not None:
            self._where.append(e)
        return self

    def group_by(self, *columns: str) -> QueryBuilder:
        return self._change(group=(*self._select.group, *[e for c in columns if (e := self._try(_expression, c)) is not None]))

    def having(self, condition: str | N.Expr) -> QueryBuilder:
        return self._change(having=self._try(_expression, condition))

    def order_by(self, column: str, descending: bool = False) -> QueryBuilder:
        e = self._try(_expression, column)
        return self._change(order=(*self._select.order, N.Key(e, descending))) if e is not None else self

    def limit(self, n: int) -> QueryBuilder:
        if n <= 0:
            self._errors.append("LIMIT is over 0")
            return self
        return self._change(limit=n)

    def offset(self, n: int) -> QueryBuilder:
        if n < 0:
            self._errors.append("OFFSET is not below 0")
            return self
        return self._change(offset=n)

    def distinct(self) -> QueryBuilder:
        return self._change(distinct=True)

    def build(self) -> N.Select:
        """The statement; all errors so far are raised together."""
        errors = list(self._errors)
        if self._select.table is None:
            errors.append("FROM is missing")
        if errors:
            raise ValidationFailed("; ".join(errors))
        where = None
        for e in self._where:
            where = e if where is None else N.Binary("and", where, e)
        return replace(self._select, items=tuple(self._items) or (N.Item(N.Star()),), where=where)

    def run(self, **params: Any) -> DataFrame:
        if self._engine is None:
            raise ValidationFailed("a builder without an engine cannot run")
        return self._engine.run(self.build(), **params)
