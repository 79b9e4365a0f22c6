"""Syntax tree of the query language: plain frozen dataclasses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


class Expr:
    """Base of expressions."""


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Col(Expr):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star(Expr):
    table: str | None = None


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # '-', '+', 'not'
    x: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Between(Expr):
    x: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class Like(Expr):
    x: Expr
    pattern: Expr
    negated: bool = False


@dataclass(frozen=True)
class InList(Expr):
    x: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class InSelect(Expr):
    x: Expr
    select: Select
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Expr):
    x: Expr
    negated: bool = False


@dataclass(frozen=True)
class Call(Expr):
    name: str  # upper case
    args: tuple[Expr, ...] = ()
    distinct: bool = False


@dataclass(frozen=True)
class Array(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None = None


@dataclass(frozen=True)
class Cast(Expr):
    x: Expr
    type: str


@dataclass(frozen=True)
class Scalar(Expr):
    select: Select


@dataclass(frozen=True)
class Exists(Expr):
    select: Select


@dataclass(frozen=True)
class Similarity(Expr):
    """``SIMILARITY`` (``distance`` false) or ``DISTANCE`` of two vectors by a metric."""

    vector: Expr
    ref: Expr
    metric: str = "cosine"
    distance: bool = False


@dataclass(frozen=True)
class SimilarTo(Expr):
    vector: Expr
    ref: Expr
    threshold: float


@dataclass(frozen=True)
class Near(Expr):
    target: Expr
    ref: Expr
    radius: Expr


@dataclass(frozen=True)
class DistanceFrom(Expr):
    target: Expr
    ref: Expr


@dataclass(frozen=True)
class Key:
    """Sort key; ``nulls_first`` None is the default: first ascending, last descending."""

    expr: Expr
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Over(Expr):
    call: Call
    partition: tuple[Expr, ...] = ()
    order: tuple[Key, ...] = ()
    frame: tuple[int | None, int | None] | None = None  # None: unbounded
    by_value: bool = False  # RANGE: the frame counts the sort key's units, not rows


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    type: str | None = None
    alias: str | None = None
    select: Select | None = None

    @property
    def label(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, full, cross, semi, anti
    table: Table
    on: Expr | None = None


@dataclass(frozen=True)
class NodePattern:
    var: str | None = None
    label: str | None = None
    where: Expr | None = None


@dataclass(frozen=True)
class EdgePattern:
    var: str | None = None
    type: str | None = None
    low: int = 1
    high: int | None = 1  # None: up to the engine's cap
    optional: bool = False
    direction: str = "out"  # out, in, both
    where: Expr | None = None


@dataclass(frozen=True)
class Pattern:
    start: NodePattern
    edge: EdgePattern
    end: NodePattern


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] = (Item(Star()),)
    table: Table | None = None
    joins: tuple[Join, ...] = ()
    traverse: tuple[Pattern, ...] = ()
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[Key, ...] = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    distinct_on: tuple[Expr, ...] = ()
    unions: tuple[tuple[str, Select], ...] = ()


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class Cascade:
    """How a cascaded field is gathered along relationships."""

    function: str
    source: str
    through: tuple[str, ...] = ()
    direction: str = "BOTH"
    decay: str | None = None
    rate: float = 0.0
    argument: float | None = None


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: str
    argument: str | None = None
    required: bool = False
    scope: str = "METADATA"
    cascade: Cascade | None = None
    formula: Expr | None = None  # of a calculated or computed field
    computed: bool = False  # by a registered function


@dataclass(frozen=True)
class SchemaStatement:
    action: str  # create, drop, describe, add, drop_field, modify, extensibility
    name: str
    fields: tuple[FieldDef, ...] = ()
    flag: bool = False  # IF [NOT] EXISTS, DETAILED
    value: str | None = None


@dataclass(frozen=True)
class StreamStatement:
    action: str  # create, drop, describe, produce, consume
    name: str
    fields: tuple[FieldDef, ...] = ()
    flag: bool = False
    rows: tuple[tuple[Expr, ...], ...] = ()
    columns: tuple[str, ...] = ()


Statement = Select | Insert | Update | Delete | SchemaStatement | StreamStatement

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "ARRAY_AGG", "STRING_AGG", "GROUP_CONCAT", "STDDEV", "VARIANCE", "MEDIAN", "PERCENTILE", "FIRST", "LAST", "VECTOR_SUM", "VECTOR_AVG", "GEOMETRIC_MEAN", "MEASURE_SUM", "MEASURE_AVG"}


def children(e: Any) -> Iterator[Expr]:
    """Direct sub-expressions; nested selects are not entered."""
    if not is_dataclass(e):
        return
    todo = [getattr(e, f.name) for f in fields(e)]
    while todo:
        x = todo.pop(0)
        if isinstance(x, Expr):
            yield x
        elif isinstance(x, Key):
            yield x.expr
        elif isinstance(x, tuple):
            todo[:0] = list(x)


def walk(e: Expr | None) -> Iterator[Expr]:
    """The expression and everything in it."""
    if e is not None:
        yield e
        for x in children(e):
            yield from walk(x)


def rewrite(e: Any, f: Callable[[Expr], Expr | None]) -> Any:
    """A copy of ``e`` where ``f`` gives another expression for a part (None: keep and go on inside)."""
    if isinstance(e, tuple):
        return tuple(rewrite(x, f) for x in e)
    if isinstance(e, Key):
        return replace(e, expr=rewrite(e.expr, f))
    if not isinstance(e, Expr):
        return e
    new = f(e)
    if new is not None:
        return new
    return replace(e, **{x.name: rewrite(getattr(e, x.name), f) for x in fields(e)})


def is_aggregate(e: Expr | None) -> bool:
    """Whether an aggregate is computed in ``e`` outside of a window."""
    if e is None or isinstance(e, Over):
        return False
    if isinstance(e, Call) and e.name in AGGREGATES:
        return True
    return any(is_aggregate(x) for x in children(e))


def output_name(item: Item) -> str:
    """Column name of a select item."""
    e = item.expr
    if item.alias:
        return item.alias
    if isinstance(e, Col):
        return f"{e.table}.{e.name}" if e.table else e.name
    if isinstance(e, Over):
        e = e.call
    if isinstance(e, Call):
        if not e.args or isinstance(e.args[0], Star):
            return f"{e.name}(*)"
        if len(e.args) == 1 and isinstance(e.args[0], Col):
            return f"{e.name}({output_name(Item(e.args[0]))})"
        return f"{e.name}(...)"
    if isinstance(e, Similarity):
        return "distance" if e.distance else "similarity"
    return "expr"


__all__ = [n for n in globals() if n[0].isupper()] + ["field"]
