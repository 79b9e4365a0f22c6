"""Relational behaviour on small collections."""

import pytest

from polystrata import Engine, QueryBuilder
from polystrata.errors import ParseError, QueryError, UndefinedReference, ValidationFailed
from polystrata.sources.catalog import Entity


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def hospital(spark):
    e = Engine(spark)
    e.register("patients", spark.createDataFrame([("p1", 1, "Alice", 30), ("p2", 2, "Bob", 45), ("p3", 3, "Charlie", 55)], "id string, subject_id long, name string, age long"))
    e.register("admissions", spark.createDataFrame([("a1", 101, 1, "EMERGENCY"), ("a2", 102, 1, "ELECTIVE"), ("a3", 103, 2, "URGENT")], "id string, hadm_id long, subject_id long, admission_type string"))
    e.register("chartevents", spark.createDataFrame([("c1", 101, 98.6, "Temperature"), ("c2", 102, 120.0, "Heart Rate"), ("c3", 103, 100.2, "Temperature")], "id string, hadm_id long, valuenum double, label string"))
    return e


@pytest.mark.parametrize(("kind", "n"), [("INNER JOIN", 3), ("JOIN", 3), ("LEFT JOIN", 4), ("RIGHT JOIN", 3), ("FULL OUTER JOIN", 4)])
def test_join_kinds(hospital, kind, n):
    assert hospital.sql(f"SELECT p.name, a.admission_type FROM patients p {kind} admissions a ON p.subject_id = a.subject_id").count() == n


def test_join_details(hospital):
    left = hospital.sql("SELECT p.name AS n, a.hadm_id AS h FROM patients p LEFT JOIN admissions a ON p.subject_id = a.subject_id WHERE a.hadm_id IS NULL")
    assert rows(left) == [("Charlie", None)]
    three = "SELECT p.name, c.valuenum FROM patients p JOIN admissions a ON p.subject_id = a.subject_id JOIN chartevents c ON a.hadm_id = c.hadm_id"
    assert hospital.sql(three).count() == 3
    assert rows(hospital.sql("SELECT p.name FROM patients p JOIN admissions a ON p.subject_id = a.subject_id WHERE p.age > 40")) == [("Bob",)]
    assert hospital.sql("SELECT p.name FROM patients p JOIN admissions a ON p.subject_id = a.subject_id ORDER BY p.age DESC").first()[0] == "Bob"
    assert hospital.sql("SELECT p.name FROM patients p JOIN admissions a ON p.subject_id = a.subject_id LIMIT 2").count() == 2
    grouped = hospital.sql("SELECT p.subject_id, COUNT(*) AS n FROM patients p JOIN admissions a ON p.subject_id = a.subject_id GROUP BY p.subject_id")
    assert sorted(rows(grouped)) == [(1, 2), (2, 1)]
    with pytest.raises(ParseError):
        hospital.sql("SELECT * FROM patients p JOIN admissions a")


def test_join_names_are_flat(spark):
    e = Engine(spark)
    e.register("users", spark.createDataFrame([("u1", 1, "Alice", 100)], "id string, subject_id long, name string, value long"))
    e.register("orders", spark.createDataFrame([("o1", 1, "Order #1", 500)], "id string, subject_id long, name string, value long"))
    df = e.sql("SELECT * FROM users u JOIN orders o ON u.subject_id = o.subject_id")
    assert df.columns == ["u_id", "u_subject_id", "u_name", "u_value", "o_id", "o_subject_id", "o_name", "o_value"]
    assert e.sql("SELECT u_name, o.value FROM users u JOIN orders o ON u.subject_id = o.subject_id").columns == ["u_name", "o.value"]


@pytest.fixture
def users(spark):
    data = [(str(i), f"User{i % 3}", f"Dept{i % 2}", 25 + i % 3, None if i % 4 == 0 else f"user{i % 3}@example.com") for i in range(10)]
    return Engine(spark).register("users", spark.createDataFrame(data, "id string, name string, department string, age long, email string"))


def test_distinct(users):
    counts = {"name": 3, "name, department": 6, "email": 4, "age": 3}
    assert {c: users.sql(f"SELECT DISTINCT {c} FROM users").count() for c in counts} == counts
    assert [r[0] for r in users.sql("SELECT DISTINCT age FROM users ORDER BY age").collect()] == [25, 26, 27]
    assert users.sql("SELECT DISTINCT department FROM users WHERE age > 25").count() == 2
    assert users.sql("SELECT DISTINCT name FROM users LIMIT 2").count() == 2
    assert users.sql("SELECT name FROM users").count() == 10


def test_distinct_is_case_sensitive(spark):
    e = Engine(spark).register("users", spark.createDataFrame([(n,) for n in ("Alice", "alice", "ALICE", "Bob", "bob")], "name string"))
    assert e.sql("SELECT DISTINCT name FROM users").count() == 5


def test_count(users):
    assert users.sql("SELECT COUNT(*) FROM users").columns == ["COUNT(*)"]
    for tail in ("", " LIMIT 1", " LIMIT 10"):
        assert users.sql("SELECT COUNT(*) AS total FROM users" + tail).first()[0] == 10
    assert users.sql("SELECT COUNT(email) AS n, MIN(email) AS m FROM users").first() == (7, "user0@example.com")
    assert users.sql("SELECT name FROM users WHERE age > 25 LIMIT 5").count() == 5


def test_predicates(users):
    one = lambda w: users.sql(f"SELECT id FROM users WHERE {w}").count()
    assert one("age = 25 OR age = 26 AND department = 'Dept0'") == 5
    assert one("(age = 25 OR age = 26) AND department = 'Dept0'") == 3
    assert one("age BETWEEN 25 AND 26 AND department = 'Dept1'") == 4
    assert one("name NOT LIKE 'User0' AND email IS NOT NULL") == 4
    assert one("name IN ('User0', 'User-1') OR name = 'a, b'") == 4
    assert one("NOT (age > 25)") == 4
    assert one("name IN ()") == 0
    assert users.sql("SELECT age / 2 AS h, age % 2 AS r, -age AS m FROM users WHERE id = '1'").first() == (13.0, 0, -26)


def test_having_and_hidden_order(users):
    got = users.sql("SELECT name, COUNT(*) AS n FROM users GROUP BY name HAVING COUNT(*) > 3 AND SUM(age) > 0 ORDER BY MAX(age)")
    assert rows(got) == [("User0", 4)]
    assert users.sql("SELECT id FROM users ORDER BY age DESC, id LIMIT 1").first()[0] == "2"
    with pytest.raises(QueryError):
        users.sql("SELECT name, age FROM users GROUP BY name")


def test_entities(spark):
    e = Engine(spark)
    e.add_entities("entities", [Entity("a", {"name": "Alice", "age": 30, "active": True}, (1.0, 2.0, 3.0)), Entity("b", {"name": "Bob", "age": 25, "active": False}, (4.0, 5.0, 6.0)), Entity("c", {"name": "Charlie", "age": 35})])
    assert rows(e.sql("SELECT name FROM entities WHERE age > 30")) == [("Charlie",)]
    assert [r[0] for r in e.sql("SELECT name FROM entities ORDER BY age DESC LIMIT 2").collect()] == ["Charlie", "Alice"]
    assert e.sql("SELECT name FROM entities WHERE age > 20 AND age < 35").count() == 2
    assert e.sql("SELECT x, z FROM entities WHERE name = 'Alice'").first() == (1.0, 3.0)
    e.add_entities("entities", [Entity("d", {"name": "Dana", "city": "Oslo"})])
    assert e.sql("SELECT city FROM entities WHERE name = 'Dana'").first()[0] == "Oslo"


def test_entity_types(spark):
    e = Engine(spark).register("docs", spark.createDataFrame([("1", "Paper"), ("2", "Note")], "id string, _type string"))
    assert e.sql("SELECT id FROM docs.Paper").count() == 1
    assert e.sql("SELECT id FROM docs").count() == 2


def test_dml(spark):
    e = Engine(spark)
    e.sql("INSERT INTO t (id, name) VALUES (1, 'a, b'), (2, NULL)")
    e.sql("INSERT INTO t (name) VALUES ('x-y')")
    e.sql("UPDATE t SET name = 'none' WHERE name IS NULL")
    assert sorted(rows(e.sql("SELECT name FROM t"))) == [("a, b",), ("none",), ("x-y",)]
    e.sql("DELETE FROM t WHERE id = 1")
    assert e.sql("SELECT * FROM t").count() == 2  # a NULL id is no match
    e.sql("DELETE FROM t")
    assert e.sql("SELECT COUNT(*) AS n FROM t").first()[0] == 0


def test_unknown_names_get_hints(users):
    with pytest.raises(UndefinedReference) as x:
        users.sql("SELECT nam FROM users")
    assert "name" in x.value.suggestions
    with pytest.raises(UndefinedReference) as x:
        users.sql("SELECT name FROM user")
    assert "users" in x.value.suggestions


def test_subqueries_and_sets(users):
    assert users.sql("SELECT id FROM users WHERE age = (SELECT MAX(age) AS m FROM users)").count() == 3
    assert users.sql("SELECT t.n AS n FROM (SELECT name, COUNT(*) AS n FROM users GROUP BY name) t WHERE t.n = 4").count() == 1
    assert users.sql("SELECT name FROM users UNION SELECT department FROM users").count() == 5
    assert users.sql("SELECT id FROM users WHERE EXISTS (SELECT id FROM users WHERE age > 100)").count() == 0


def test_parameters_and_vectors(spark):
    data = [("doc1", [0.8, 0.6, 0.1, 0.2]), ("doc2", [0.9, 0.5, 0.2, 0.3]), ("doc3", [0.1, 0.2, 0.9, 0.8]), ("doc4", [0.85, 0.55, 0.15, 0.25])]
    e = Engine(spark).register("documents", spark.createDataFrame(data, "id string, embedding array<double>"))
    q = [0.8, 0.6, 0.1, 0.2]
    near = e.sql("SELECT id FROM documents ORDER BY DISTANCE(embedding, @q, 'euclidean') LIMIT 2", q=q)
    assert [r[0] for r in near.collect()] == ["doc1", "doc4"]
    assert e.sql("SELECT id FROM documents WHERE SIMILARITY(embedding, [0.8, 0.6, 0.1, 0.2], 'cosine') > 0.8 AND id <> 'doc1'").count() == 2
    assert e.sql("SELECT id FROM documents WHERE embedding SIMILAR TO @q THRESHOLD 0.99", q=q).count() == 2
    with pytest.raises(Exception, match="dimensions"):
        e.sql("SELECT SIMILARITY(embedding, [1.0], 'dot') AS s FROM documents").collect()


def test_geometry(spark):
    data = [("origin", (1.0, 0.0, 0.0)), ("nearby1", (1.01, 0.1, 0.1)), ("nearby2", (1.02, 0.15, 0.05)), ("distant", (2.0, 1.0, 1.0))]
    e = Engine(spark).register("entities", spark.createDataFrame(data, "name string, position struct<x:double,y:double,z:double>"))
    assert e.sql("SELECT name FROM entities WHERE position NEAR origin WITHIN 0.3").count() == 3
    d = e.sql("SELECT HYPERBOLIC_DISTANCE(position, origin) AS d FROM entities WHERE name = 'origin'").first()[0]
    assert abs(d - 0.004472) < 1e-5
    order = e.sql("SELECT name FROM entities ORDER BY position DISTANCE FROM POSITION(1, 0, 0)")
    assert [r[0] for r in order.collect()][0] == "origin" and order.count() == 4


def test_graph(spark):
    e = Engine(spark, undirected_arrows=True)
    e.register("User", spark.createDataFrame([("user1", "Alice"), ("user2", "Bob")], "id string, name string"))
    e.register("relationships", spark.createDataFrame([("rel1", "user1", "user2", "follows")], "id string, from_id string, to_id string, type string"))
    assert e.sql("SELECT * FROM User TRAVERSE (a:User)-[r:follows]->(b:User)").count() == 2
    assert Engine.sql(_directed(e), "SELECT * FROM User TRAVERSE (a:User)-[r:follows]->(b:User)").count() == 1


def _directed(e):
    e.graph.undirected_arrows = False
    return e


def test_graph_paths(spark):
    e = Engine(spark)
    e.register("nodes", spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "id string"))
    e.register("relationships", spark.createDataFrame([("a", "b", "knows", 1.0), ("b", "c", "knows", 1.0), ("a", "c", "knows", 5.0)], "from_id string, to_id string, type string, weight double"))
    got = e.sql("SELECT a, b, r FROM nodes TRAVERSE (a:nodes)-[r:knows*1..2]->(b)")
    assert sorted(rows(got)) == [("a", "b", "path_depth_1"), ("a", "c", "path_depth_1"), ("b", "c", "path_depth_1")]
    optional = e.sql("SELECT a, b FROM nodes TRAVERSE (a:nodes)-[r:knows?]->(b)")
    assert ("z", None) in rows(optional)
    assert sorted(rows(e.sql("SELECT a, b FROM nodes TRAVERSE (a:nodes)<-[:knows]-(b)"))) == [("b", "a"), ("c", "a"), ("c", "b")]
    assert dict(rows(e.graph.weighted_paths("a"))) == {"a": 0.0, "b": 1.0, "c": 2.0}
    assert {r.node_id: r.distance for r in e.graph.shortest_path("a").collect()} == {"a": 0, "b": 1, "c": 1}
    assert {tuple(r.path) for r in e.graph.simple_paths("a", "c").collect()} == {("a", "c"), ("a", "b", "c")}
    assert abs(sum(r.rank for r in e.graph.pagerank(5).collect()) - 1) < 1e-9
    assert {r.component for r in e.graph.connected_components().collect()} == {"a"}


def test_builder_and_validation(users):
    got = users.builder().select("name", "COUNT(*) AS n").from_("users").where_expr("age > 20").group_by("name").order_by("n", descending=True).limit(1).run()
    assert rows(got) == [("User0", 4)]
    with pytest.raises(ValidationFailed, match="LIMIT"):
        QueryBuilder().from_("t").limit(0).build()
    with pytest.raises(ValidationFailed, match="FROM"):
        QueryBuilder().select("a").build()


def test_streams(spark):
    e = Engine(spark)
    e.sql("CREATE STREAM s (k INTEGER, v STRING)")
    e.sql("PRODUCE INTO s (k, v) VALUES (1, 'a')")
    e.sql("PRODUCE INTO s (v) VALUES ('b')")
    assert sorted(rows(e.sql("CONSUME FROM s")), key=str) == [(1, "a"), (None, "b")]
    fired = []
    from pyspark.sql import functions as F

    e.streams.on(e.streams.read("s"), F.col("v") == "a", lambda batch, _: fired.append(batch.count()))
    assert fired == [1]
    assert e.sql("DROP STREAM s").first()[0] == "dropped"


def test_udfs(users):
    users.functions.register("double_age", lambda c: c * 2)
    users.functions.register("double_age", lambda c: c * 3)
    assert users.sql("SELECT DOUBLE_AGE(age) AS d FROM users WHERE id = '0'").first()[0] == 75
    assert users.functions.get("double_age", 1).version == 1 and users.functions.search("double")[0].version == 2


def test_pushdown_reaches_the_scan(spark):
    e = Engine(spark).load_folder("/root/testdata/sf0.001", ["lineitem"])
    plan = e.explain("SELECT l_orderkey FROM lineitem WHERE l_quantity > 49.0")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
