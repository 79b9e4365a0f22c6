"""Tokenizer and recursive-descent parser of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..errors import ParseError, close_names
from .nodes import (
    AGGREGATES, Array, Between, Binary, Call, Cascade, Case, Cast, Col, Delete, DistanceFrom, EdgePattern, Exists, Expr, FieldDef, InList, InSelect, Insert, IsNull, Item, Join, Key, Like, Lit, Near,
    NodePattern, Over, Param, Pattern, Scalar, SchemaStatement, Select, SimilarTo, Similarity, Star, Statement, StreamStatement, Table, Unary, Update,
)

_TOKEN = re.compile(
    r"""(?P<space>\s+|--(?=[ \t])[^\n]*)
  | (?P<number>(?:\d+\.(?!\.)\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  | (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")
  | (?P<param>[@$][A-Za-z_]\w*)
  | (?P<name>[^\W\d]\w*|`[^`]+`)
  | (?P<op>\.\.|<>|!=|<=|>=|->|<-|[-+*/%(),.<>=\[\]:;?])""",
    re.X,
)

CLAUSES = {"FROM", "TRAVERSE", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "SEMI", "ANTI", "ON"}
_WORD_OPERATORS = {"AND", "OR", "NOT", "IN", "LIKE", "BETWEEN", "IS", "NEAR", "WITHIN", "SIMILAR", "THRESHOLD", "DISTANCE", "ASC", "DESC", "NULLS", "AS", "THEN", "WHEN", "ELSE", "END"}
METRICS = {"cosine": "cosine", "dot": "dot", "dotproduct": "dot", "dot_product": "dot", "euclidean": "euclidean", "l2": "euclidean", "manhattan": "manhattan", "l1": "manhattan", "jaccard": "jaccard", "hamming": "hamming"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    """All tokens of ``text``, and an end token."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError("unexpected character", position=at, text=text)
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group(), at))
        at = m.end()
    return [*out, Token("end", "", len(text))]


def _unquote(raw: str) -> str:
    body = raw[1:-1]
    if raw[0] == "'":
        body = body.replace("''", "'")
    # a backslash stays before % and _ (a LIKE pattern); elsewhere it quotes
    return re.sub(r"\\([^%_])", r"\1", body)


class Parser:
    """One statement."""

    def __init__(self, text: str):
        self.text, self.toks, self.i = text, tokens(text), 0

    # -- tokens -----------------------------------------------------------

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def word(self, *words: str, ahead: int = 0) -> bool:
        t = self.toks[min(self.i + ahead, len(self.toks) - 1)]
        return t.kind == "name" and t.text.upper() in words

    def op(self, *ops: str, ahead: int = 0) -> bool:
        t = self.toks[min(self.i + ahead, len(self.toks) - 1)]
        return t.kind == "op" and t.text in ops

    def take(self) -> Token:
        self.i += 1
        return self.toks[self.i - 1]

    def skip(self, *words: str) -> bool:
        """Take the words if they all come next."""
        if all(self.word(w, ahead=k) for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def skip_op(self, op: str) -> bool:
        if self.op(op):
            self.i += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.skip(*words):
            self.fail(f"expected {' '.join(words)}")

    def need_op(self, op: str) -> None:
        if not self.skip_op(op):
            self.fail(f"expected {op!r}")

    def fail(self, message: str, suggestions=()) -> None:
        raise ParseError(message, suggestions, self.tok.at, self.text)

    def name(self) -> str:
        if self.tok.kind != "name":
            self.fail("expected a name")
        return self.take().text.strip("`")

    def number(self) -> float | int:
        sign = -1 if self.skip_op("-") else 1
        if self.tok.kind != "number":
            self.fail("expected a number")
        raw = self.take().text
        return sign * (int(raw) if raw.isdigit() else float(raw))

    def whole(self) -> int:
        n = self.number()
        if not isinstance(n, int) or n < 0:
            self.fail("expected a whole number")
        return n

    # -- statements -------------------------------------------------------

    def statement(self) -> Statement:
        starts = {"SELECT": self.select, "INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete, "CREATE": self.ddl, "ALTER": self.ddl, "DROP": self.ddl, "DESCRIBE": self.ddl, "PRODUCE": self.produce, "CONSUME": self.consume}
        first = self.tok.text.upper()
        if first not in starts:
            self.fail("expected a statement", close_names(first, starts))
        out = starts[first]()
        self.skip_op(";")
        if self.tok.kind != "end":
            self.fail("unexpected text after the statement", close_names(self.tok.text, CLAUSES))
        return out

    def comma(self, part) -> tuple:
        out = [part()]
        while self.skip_op(","):
            out.append(part())
        return tuple(out)

    def select(self) -> Select:
        out = self.select_core()
        unions = []
        while self.word("UNION", "INTERSECT", "EXCEPT"):
            kind = self.take().text.lower()
            unions.append((kind + ("_all" if self.skip("ALL") else ""), self.select_core(tail=False)))
        if unions:
            out = self.tail(replace(out, unions=tuple(unions)))
        return out

    def select_core(self, tail: bool = True) -> Select:
        self.need("SELECT")
        distinct, on = self.skip("DISTINCT"), ()
        if distinct and self.word("ON") and self.op("(", ahead=1):
            self.i += 2
            on, distinct = self.comma(self.expr), False
            self.need_op(")")
        out = Select(items=self.comma(self.item), distinct=distinct, distinct_on=on)
        if self.skip("FROM"):
            out = replace(out, table=self.table())
            joins = []
            while (kind := self.join_kind()) is not None:
                joins.append(self.join(kind))
            out = replace(out, joins=tuple(joins))
        if self.skip("TRAVERSE"):
            out = replace(out, traverse=self.comma(self.pattern))
        if self.skip("WHERE"):
            out = replace(out, where=self.expr())
        if self.skip("GROUP", "BY"):
            out = replace(out, group=self.grouping())
        if self.skip("HAVING"):
            out = replace(out, having=self.expr())
        return self.tail(out) if tail else out

    def grouping(self) -> tuple[Expr, ...]:
        """Grouping keys; ROLLUP, CUBE and GROUPING SETS are calls, the last one of arrays."""
        if not self.skip("GROUPING", "SETS"):
            return self.comma(self.expr)
        self.need_op("(")
        sets = self.comma(self.grouping_set)
        self.need_op(")")
        return (Call("GROUPING SETS", sets),)

    def grouping_set(self) -> Expr:
        if not self.skip_op("("):
            return Array((self.expr(),))
        keys = () if self.op(")") else self.comma(self.expr)
        self.need_op(")")
        return Array(keys)

    def tail(self, out: Select) -> Select:
        if self.skip("ORDER", "BY"):
            out = replace(out, order=self.comma(self.key))
        while self.word("LIMIT", "OFFSET"):
            which = self.take().text.lower()
            out = replace(out, **{which: self.whole()})
        return out

    def item(self) -> Item:
        if self.op("*"):
            self.take()
            return Item(Star())
        if self.tok.kind == "name" and self.op(".", ahead=1) and self.op("*", ahead=2):
            table = self.name()
            self.i += 2
            return Item(Star(table))
        e = self.expr()
        if self.skip("AS"):
            return Item(e, _unquote(self.take().text) if self.tok.kind == "string" else self.name())
        if self.tok.kind == "name" and self.tok.text.upper() not in CLAUSES:
            return Item(e, self.name())
        return Item(e)

    def key(self) -> Key:
        e = self.expr()
        if self.skip("DISTANCE", "FROM"):
            e = DistanceFrom(e, self.add())
        down = self.skip("DESC")
        if not down:
            self.skip("ASC")
        nulls = None
        if self.skip("NULLS"):
            nulls = self.skip("FIRST")
            if not nulls:
                self.need("LAST")
        return Key(e, down, nulls)

    def table(self) -> Table:
        if self.skip_op("("):
            inner = self.select()
            self.need_op(")")
            self.skip("AS")
            alias = self.name()
            return Table(alias, None, alias, inner)
        name, kind = self.name(), None
        if self.skip_op("."):
            kind = self.name()
        alias = None
        if self.skip("AS") or (self.tok.kind == "name" and self.tok.text.upper() not in CLAUSES):
            alias = self.name()
        return Table(name, kind, alias)

    def join_kind(self) -> str | None:
        if self.skip("JOIN") or self.skip("INNER", "JOIN"):
            return "inner"
        for kind in ("LEFT", "RIGHT", "FULL"):
            if self.skip(kind, "OUTER", "JOIN") or self.skip(kind, "JOIN"):
                return kind.lower()
        for kind in ("CROSS", "SEMI", "ANTI"):
            if self.skip(kind, "JOIN"):
                return kind.lower()
        return None

    def join(self, kind: str) -> Join:
        table = self.table()
        if kind == "cross":
            return Join(kind, table)
        if not self.skip("ON"):
            self.fail("a JOIN needs ON and a condition")
        return Join(kind, table, self.expr())

    # -- graph patterns ---------------------------------------------------

    def node(self) -> NodePattern:
        self.need_op("(")
        var = self.name() if self.tok.kind == "name" else None
        label = None
        if self.skip_op(":"):
            label = self.name()
            if self.skip_op("."):
                label += "." + self.name()
        where = self.expr() if self.skip("WHERE") else None
        self.need_op(")")
        return NodePattern(var, label, where)

    def pattern(self) -> Pattern:
        start = self.node()
        back = self.skip_op("<-")
        if not back:
            self.need_op("-")
        edge = EdgePattern()
        if self.skip_op("["):
            edge = self.edge_spec()
            self.need_op("]")
            if self.op("<-"):  # '-[..]<-' names an incoming edge as well
                self.take()
                edge = replace(edge, direction="in")
            elif self.skip_op("->"):
                edge = replace(edge, direction="both" if back else "out")
            else:
                self.need_op("-")
                edge = replace(edge, direction="in" if back else "both")
        elif back:
            self.need_op("-")
            edge = replace(edge, direction="in")
        elif self.skip_op("->"):
            pass
        else:
            self.need_op("-")
            edge = replace(edge, direction="both")
        return Pattern(start, edge, self.node())

    def edge_spec(self) -> EdgePattern:
        var = kind = where = None
        if self.tok.kind == "name" and self.op(":", ahead=1):
            var = self.name()
        self.skip_op(":")
        if self.tok.kind == "name" and not self.word("WHERE"):
            kind = self.name()
        low, high = 1, 1
        if self.skip_op("*"):
            if self.tok.kind == "number":
                low = high = self.whole()
            if self.skip_op(".."):
                low = low if high == low and self.toks[self.i - 2].kind == "number" else 1
                high = self.whole() if self.tok.kind == "number" else None
        optional = self.skip_op("?")
        if self.skip("WHERE"):
            where = self.expr()
        return EdgePattern(var, kind, low, high, optional, "out", where)

    # -- expressions ------------------------------------------------------

    def expr(self) -> Expr:
        out = self.conjunction()
        while self.skip("OR"):
            out = Binary("or", out, self.conjunction())
        return out

    def conjunction(self) -> Expr:
        out = self.negation()
        while self.skip("AND"):
            out = Binary("and", out, self.negation())
        return out

    def negation(self) -> Expr:
        if self.skip("NOT"):
            return Unary("not", self.negation())
        return self.predicate()

    def predicate(self) -> Expr:
        out = self.add()
        while True:
            if self.op("=", "!=", "<>", "<", "<=", ">", ">="):
                op = self.take().text
                out = Binary("!=" if op == "<>" else op, out, self.add())
            elif self.skip("IS"):
                negated = self.skip("NOT")
                self.need("NULL")
                out = IsNull(out, negated)
            elif self.word("NEAR"):
                self.take()
                ref = self.add()
                self.need("WITHIN")
                out = Near(out, ref, self.add())
            elif self.skip("SIMILAR", "TO"):
                ref = self.add()
                self.need("THRESHOLD")
                out = SimilarTo(out, ref, float(self.number()))
            elif self.word("BETWEEN", "LIKE", "IN") or (self.word("NOT") and self.word("BETWEEN", "LIKE", "IN", ahead=1)):
                negated = self.skip("NOT")
                if self.skip("BETWEEN"):
                    low = self.add()
                    self.need("AND")
                    out = Between(out, low, self.add(), negated)
                elif self.skip("LIKE"):
                    out = Like(out, self.add(), negated)
                else:
                    self.need("IN")
                    self.need_op("(")
                    if self.word("SELECT"):
                        out = InSelect(out, self.select(), negated)
                    else:
                        out = InList(out, () if self.op(")") else self.comma(self.expr), negated)
                    self.need_op(")")
            else:
                return out

    def add(self) -> Expr:
        out = self.multiply()
        while self.op("+", "-"):
            out = Binary(self.take().text, out, self.multiply())
        return out

    def multiply(self) -> Expr:
        out = self.unary()
        while self.op("*", "/", "%"):
            out = Binary(self.take().text, out, self.unary())
        return out

    def unary(self) -> Expr:
        if self.op("-", "+"):
            op, x = self.take().text, self.unary()
            if isinstance(x, Lit) and isinstance(x.value, int | float) and not isinstance(x.value, bool):
                return Lit(-x.value if op == "-" else x.value)
            return Unary(op, x)
        return self.primary()

    def primary(self) -> Expr:
        t = self.tok
        if t.kind == "number":
            return Lit(self.number())
        if t.kind == "string":
            return Lit(_unquote(self.take().text))
        if t.kind == "param":
            return Param(self.take().text[1:])
        if self.skip_op("("):
            if self.word("SELECT"):
                inner: Expr = Scalar(self.select())
            else:
                inner = self.expr()
            self.need_op(")")
            return inner
        if self.skip_op("["):
            items = () if self.op("]") else self.comma(self.expr)
            self.need_op("]")
            return Array(items)
        if t.kind != "name":
            self.fail("expected an expression")
        upper = t.text.upper()
        if upper in ("TRUE", "FALSE", "NULL"):
            self.take()
            return Lit({"TRUE": True, "FALSE": False, "NULL": None}[upper])
        if upper == "CASE":
            return self.case()
        if upper == "EXISTS" and self.op("(", ahead=1):
            self.i += 2
            inner_select = self.select()
            self.need_op(")")
            return Exists(inner_select)
        if self.op("(", ahead=1):
            return self.call()
        if upper in CLAUSES or upper in _WORD_OPERATORS:
            self.fail("expected an expression")
        name = self.name()
        if self.op(".") and self.toks[self.i + 1].kind == "name":
            self.take()
            return Col(self.name(), name)
        return Col(name)

    def case(self) -> Expr:
        self.take()
        base = None if self.word("WHEN") else self.expr()
        whens = []
        while self.skip("WHEN"):
            test = self.expr()
            self.need("THEN")
            whens.append((test if base is None else Binary("=", base, test), self.expr()))
        default = self.expr() if self.skip("ELSE") else None
        self.need("END")
        return Case(tuple(whens), default)

    def call(self) -> Expr:
        name = self.name().upper()
        self.need_op("(")
        if name == "CAST":
            x = self.expr()
            self.need("AS")
            kind = self.name()
            self.need_op(")")
            return Cast(x, kind)
        if name in ("SIMILARITY", "DISTANCE"):
            args = self.comma(self.expr)
            self.need_op(")")
            metric = "cosine" if name == "SIMILARITY" else "euclidean"
            if len(args) not in (2, 3):
                self.fail(f"{name} takes a vector, a reference and a metric")
            if len(args) == 3:
                if not isinstance(args[2], Lit) or not isinstance(args[2].value, str):
                    self.fail("the metric is a quoted name")
                if args[2].value.lower() not in METRICS:
                    self.fail(f"unknown metric {args[2].value!r}", close_names(args[2].value, METRICS))
                metric = METRICS[args[2].value.lower()]
            return Similarity(args[0], args[1], metric, name == "DISTANCE")
        distinct, args = self.skip("DISTINCT"), ()
        if self.op("*"):
            self.take()
            args = (Star(),)
        elif not self.op(")"):
            args = self.comma(self.expr)
        self.need_op(")")
        out = Call(name, args, distinct)
        return self.over(out) if self.skip("OVER") else out

    def over(self, call: Call) -> Expr:
        self.need_op("(")
        partition: tuple = ()
        order: tuple = ()
        frame, by_value = None, False
        if self.skip("PARTITION", "BY"):
            partition = self.comma(self.expr)
        if self.skip("ORDER", "BY"):
            order = self.comma(self.key)
        if self.word("ROWS", "RANGE"):
            by_value = self.take().text.upper() == "RANGE"
            if self.skip("BETWEEN"):
                low = self.bound()
                self.need("AND")
                frame = (low, self.bound())
            else:
                frame = (self.bound(), 0)
        self.need_op(")")
        return Over(call, partition, order, frame, by_value)

    def bound(self) -> int | None:
        if self.skip("UNBOUNDED"):
            self.take()
            return None
        if self.skip("CURRENT", "ROW"):
            return 0
        n = self.number()
        if self.skip("PRECEDING"):
            return -n
        self.need("FOLLOWING")
        return n

    # -- DML --------------------------------------------------------------

    def row(self) -> tuple[Expr, ...]:
        self.need_op("(")
        out = self.comma(self.expr)
        self.need_op(")")
        return out

    def names(self) -> tuple[str, ...]:
        self.need_op("(")
        out = self.comma(self.name)
        self.need_op(")")
        return out

    def insert(self) -> Insert:
        self.need("INSERT", "INTO")
        table, columns = self.name(), self.names()
        self.need("VALUES")
        rows = self.comma(self.row)
        if any(len(r) != len(columns) for r in rows):
            raise ParseError(f"INSERT names {len(columns)} columns; a row has another number of values")
        return Insert(table, columns, rows)

    def assignment(self) -> tuple[str, Expr]:
        column = self.name()
        self.need_op("=")
        return column, self.expr()

    def update(self) -> Update:
        self.need("UPDATE")
        table = self.name()
        self.need("SET")
        sets = self.comma(self.assignment)
        return Update(table, sets, self.expr() if self.skip("WHERE") else None)

    def delete(self) -> Delete:
        self.need("DELETE", "FROM")
        return Delete(self.name(), self.expr() if self.skip("WHERE") else None)

    # -- schemas and streams ----------------------------------------------

    def ddl(self) -> SchemaStatement | StreamStatement:
        action = self.take().text.lower()
        if self.skip("STREAM"):
            flag = self.skip("IF", "NOT", "EXISTS") or self.skip("IF", "EXISTS")
            name = self.name()
            return StreamStatement(action, name, self.field_list() if action == "create" else (), flag)
        self.need("SCHEMA")
        if action == "create":
            flag = self.skip("IF", "NOT", "EXISTS")
            name, made = self.name(), self.field_list()
            mode = self.extensibility() if self.skip("WITH", "EXTENSIBILITY") else "OPEN"
            return SchemaStatement("create", name, made, flag, mode)
        if action == "drop":
            flag = self.skip("IF", "EXISTS")
            return SchemaStatement("drop", self.name(), flag=flag)
        if action == "describe":
            name = self.name()
            return SchemaStatement("describe", name, flag=self.skip("DETAILED"))
        name = self.name()
        if self.skip("ADD", "FIELD"):
            return SchemaStatement("add", name, (self.field(),))
        if self.skip("DROP", "FIELD"):
            return SchemaStatement("drop_field", name, value=self.name())
        if self.skip("MODIFY", "FIELD"):
            return SchemaStatement("modify", name, (self.field(),))
        self.need("SET", "EXTENSIBILITY")
        return SchemaStatement("extensibility", name, value=self.extensibility())

    def extensibility(self) -> str:
        mode = self.name().upper()
        if mode not in ("CLOSED", "OPEN", "TYPED"):
            self.fail("extensibility is CLOSED, OPEN or TYPED")
        return mode

    def field_list(self) -> tuple[FieldDef, ...]:
        self.need_op("(")
        out = () if self.op(")") else self.comma(self.field)
        self.need_op(")")
        return out

    def field(self) -> FieldDef:
        from ..sources.schemas import FIELD_TYPES

        name, kind, argument = self.name(), self.name().upper(), None
        if kind not in FIELD_TYPES:
            self.fail(f"unknown field type {kind}", close_names(kind, FIELD_TYPES))
        if self.skip_op("("):
            argument = self.take().text
            self.need_op(")")
        required, scope, cascade, formula, computed = False, "METADATA", None, None, False
        while True:
            if self.skip("REQUIRED"):
                required = True
            elif self.skip("OPTIONAL"):
                required = False
            elif self.word("METADATA", "COLLECTION_SPECIFIC", "DOMAIN_SHARED"):
                scope = self.name().upper()
            elif self.skip("CASCADED"):
                cascade = self.cascade()
            elif self.skip("CALCULATED"):
                self.need("AS")
                formula = self.expr()
            elif self.skip("COMPUTED"):
                self.need("AS")
                formula, computed = self.expr(), True
                if not isinstance(formula, Call):
                    self.fail("a computed field names a function and its arguments")
            else:
                return FieldDef(name, kind, argument, required, scope, cascade, formula, computed)

    def cascade(self) -> Cascade:
        from ..operators.cascade import FUNCTIONS

        self.need("AS", "AGGREGATE")
        function, argument = self.name().upper().replace("_", ""), None
        if function not in FUNCTIONS:
            self.fail(f"unknown aggregation {function}", close_names(function, FUNCTIONS))
        if self.skip_op("("):
            argument = float(self.number())
            self.need_op(")")
        self.need("FROM")
        source, through, direction, decay, rate = self.name(), [], "BOTH", None, 0.0
        if self.skip("THROUGH"):
            while self.tok.kind == "name" and not self.word("INCOMING", "OUTGOING", "BOTH", "WITH", "REQUIRED", "OPTIONAL", "METADATA", "COLLECTION_SPECIFIC", "DOMAIN_SHARED"):
                through.append(self.name())
                self.skip_op("|")
        if self.word("INCOMING", "OUTGOING", "BOTH"):
            direction = self.name().upper()
        if self.skip("WITH", "DECAY"):
            decay = self.name().upper().replace("_", "")
            if decay not in ("NONE", "EXPONENTIAL", "POWERLAW", "LINEAR"):
                self.fail(f"unknown decay {decay}")
            if self.skip_op("("):
                rate = float(self.number())
                self.need_op(")")
        return Cascade(function, source, tuple(through), direction, decay, rate, argument)

    def produce(self) -> StreamStatement:
        self.need("PRODUCE")
        self.skip("INTO")
        name, columns = self.name(), self.names()
        self.need("VALUES")
        return StreamStatement("produce", name, columns=columns, rows=self.comma(self.row))

    def consume(self) -> StreamStatement:
        self.need("CONSUME")
        self.skip("FROM")
        return StreamStatement("consume", self.name())


def parse(text: str) -> Statement:
    """The syntax tree of one statement."""
    return Parser(text).statement()


__all__ = ["AGGREGATES", "METRICS", "parse", "tokens"]
