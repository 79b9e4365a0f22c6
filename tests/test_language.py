"""Parser, validator, type checker, schemas."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polystrata import Engine
from polystrata.errors import ParseError, SchemaError, TypeMismatch
from polystrata.operators.vector import check_compatible, check_knn
from polystrata.plans import nodes as N
from polystrata.plans.grammar import parse
from polystrata.plans.validate import Validator


def test_metrics_and_references():
    e = parse("SELECT * FROM d WHERE SIMILARITY(v, q, 'cosine') > 0.8").where
    assert e == N.Binary(">", N.Similarity(N.Col("v"), N.Col("q"), "cosine"), N.Lit(0.8))
    assert parse("SELECT * FROM d WHERE v similar to q threshold 0.5").where == N.SimilarTo(N.Col("v"), N.Col("q"), 0.5)
    assert parse("SELECT * FROM e WHERE position NEAR origin WITHIN 2.5").where == N.Near(N.Col("position"), N.Col("origin"), N.Lit(2.5))
    with pytest.raises(ParseError):
        parse("SELECT DISTANCE(v, q, 'nope') FROM d")


@pytest.mark.parametrize(
    ("text", "low", "high", "direction"),
    [("-[r:t]->", 1, 1, "out"), ("-[r:t*3]->", 3, 3, "out"), ("-[r:t*1..4]-", 1, 4, "both"), ("-[r:t*..4]->", 1, 4, "out"), ("-[r:t*2..]->", 2, None, "out"), ("<-[r:t]-", 1, 1, "in"), ("-[r:t]<-", 1, 1, "in"), ("-->", 1, 1, "out"), ("--", 1, 1, "both"), ("<--", 1, 1, "in")],
)
def test_edges(text, low, high, direction):
    p = parse(f"SELECT * FROM n TRAVERSE (a:n){text}(b)").traverse[0]
    assert (p.edge.low, p.edge.high, p.edge.direction) == (low, high, direction)


def test_output_names():
    s = parse("SELECT a, t.b, COUNT(*), SUM(x), MAX(x + 1), x + 1, y AS z FROM t")
    assert [N.output_name(i) for i in s.items] == ["a", "t.b", "COUNT(*)", "SUM(x)", "MAX(...)", "expr", "z"]


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.integers(0, 99).map(str), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=8))
def test_arithmetic_parses_like_python(text):
    def value(e):
        if isinstance(e, N.Lit):
            return e.value
        a, b = value(e.left), value(e.right)
        return {"+": a + b, "-": a - b, "*": a * b}[e.op]

    assert value(parse(f"SELECT {text} AS v").items[0].expr) == eval(text)


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_characters="\\"), max_size=20))
def test_string_literals_round_trip(s):
    quoted = s.replace("'", "''")
    got = parse(f"SELECT '{quoted}' AS v").items[0].expr
    assert got == N.Lit(s)


def kinds(text, schema=None):
    r = Validator(schema).check(parse(text))
    return {i.kind for i in r.errors}, {i.kind for i in r.warnings}


def test_validator_rules():
    assert kinds("SELECT a FROM t WHERE COUNT(a) > 1")[0] == {"aggregate"}
    assert kinds("SELECT a FROM t HAVING a > 1")[0] == {"group_by"}
    assert kinds("SELECT SUM(MAX(a)) AS x FROM t")[0] == {"aggregate"}
    assert kinds("SELECT a, COUNT(*) AS n FROM t GROUP BY b")[0] == {"group_by"}
    assert kinds("SELECT a FROM t LIMIT 0")[0] == {"range"}
    assert kinds("SELECT a FROM t OFFSET 3")[1] == {"offset_without_limit"}
    assert kinds("UPDATE t SET a = 1")[1] == {"missing_where"}
    assert kinds("DELETE FROM t")[1] == {"missing_where"}
    assert kinds("INSERT INTO t (a, a) VALUES (1, 2)")[0] == {"duplicate"}
    assert kinds("SELECT ROUND() AS r FROM t")[0] == {"arity"}
    assert kinds("SELECT a / 0 AS r FROM t")[0] == {"arithmetic"}
    assert kinds("SELECT a FROM t WHERE 1 = 1")[1] == {"always_true"}
    assert kinds("SELECT x AS a, y AS a FROM t")[0] == {"duplicate"}
    schema = {"users": ["id", "name"], "orders": ["id", "user_id"]}
    assert kinds("SELECT nme FROM users", schema)[0] == {"unknown_column"}
    assert kinds("SELECT id FROM user", schema)[0] == {"unknown_table"}
    assert kinds("SELECT id FROM users u JOIN orders o ON u.id = o.user_id", schema)[0] == {"ambiguous_column"}
    assert kinds("SELECT u.name FROM users u JOIN orders o ON u.id = o.user_id", schema) == (set(), set())
    bad = Validator(schema).check(parse("SELECT nme FROM users")).errors[0]
    assert "name" in bad.suggestions
    assert not Validator(strict=True).check(parse("DELETE FROM t")).valid


def test_vector_bounds():
    with pytest.raises(Exception, match="jaccard"):
        check_compatible("jaccard", "dense")
    for bad in ({"k": 0}, {"k": 10_001}, {"k": 5, "factor": 1.5}, {"k": 5, "threads": 65}):
        with pytest.raises(Exception):
            check_knn(**bad)


DDL = """CREATE SCHEMA topics (id STRING REQUIRED, name STRING REQUIRED COLLECTION_SPECIFIC, tags ARRAY(STRING), m MAP(STRING), v EMBEDDING(768),
avg_sentiment FLOAT CASCADED AS AGGREGATE AVERAGE FROM sentiment THROUGH tagged_with mentions INCOMING WITH DECAY EXPONENTIAL(0.5),
p FLOAT CASCADED AS AGGREGATE PERCENTILE(95) FROM latency) WITH EXTENSIBILITY CLOSED"""


def test_schemas(spark):
    e = Engine(spark)
    assert e.sql(DDL).first() == ("created", "topics", 7)
    f = e.catalog.schemas.get("topics").fields
    assert f["avg_sentiment"].cascade == N.Cascade("AVERAGE", "sentiment", ("tagged_with", "mentions"), "INCOMING", "EXPONENTIAL", 0.5)
    assert f["p"].cascade.argument == 95 and f["name"].scope == "COLLECTION_SPECIFIC" and f["v"].argument == "768"
    e.sql("ALTER SCHEMA topics ADD FIELD born TIMESTAMP")
    e.sql("ALTER SCHEMA topics MODIFY FIELD born DATE")
    e.sql("ALTER SCHEMA topics DROP FIELD m")
    described = {r.field: r.type for r in e.sql("DESCRIBE SCHEMA topics").collect()}
    assert described["born"] == "DATE" and "m" not in described
    with pytest.raises(SchemaError):
        e.sql(DDL)
    assert e.sql(DDL.replace("SCHEMA topics", "SCHEMA IF NOT EXISTS topics")).first()[0] == "exists"
    df = spark.createDataFrame([("1", "n", 3)], "id string, name string, extra int")
    with pytest.raises(SchemaError, match="closed"):
        e.catalog.schemas.get("topics").conform(df)
    e.sql("ALTER SCHEMA topics SET EXTENSIBILITY OPEN")
    assert e.catalog.schemas.get("topics").conform(df).first()["_extra"] == {"extra": "3"}
    e.sql("DROP SCHEMA topics")
    assert e.sql("DROP SCHEMA IF EXISTS topics").first()[0] == "absent"


def test_types(spark):
    e = Engine(spark).register("t", spark.createDataFrame([(1, "a", 2.0)], "i long, s string, d double"))
    assert e.check_types("SELECT i + 1 AS a, i / 2 AS b, UPPER(s) AS c, i > d AS e FROM t") == {"a": "integer", "b": "float", "c": "string", "e": "bool"}
    with pytest.raises(TypeMismatch):
        e.check_types("SELECT s + 1 AS x FROM t")
    with pytest.raises(TypeMismatch):
        e.check_types("SELECT i FROM t WHERE s = 1")


def test_metadata(spark):
    m = Engine(spark).metadata("SELECT a, SIMILARITY(v, q, 'cosine') AS s FROM t WHERE position NEAR origin WITHIN 2 ORDER BY s LIMIT 3")
    assert m.tables == ["t"] and m.paradigms == ["relational", "vector", "geometric"] and "topk" in m.operations
