"""Kernels and operators against NumPy and plain Python."""

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polystrata import Engine, templates
from polystrata.errors import GeometricError, GraphError, VectorError
from polystrata.functions import kernels as K
from polystrata.operators import cascade, geometry, temporal, vector
from polystrata.plans.nodes import Cascade


def test_kernels_match_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(20, 8)), rng.normal(size=(20, 8))
    df = spark.createDataFrame([(k, x.tolist(), y.tolist()) for k, (x, y) in enumerate(zip(a, b, strict=True))], "id int, a array<double>, b array<double>")
    x, y = F.col("a"), F.col("b")
    got = df.orderBy("id").select(K.dot(x, y), K.cosine(x, y), K.euclidean(x, y), K.manhattan(x, y), K.norm(x), K.similarity(x, y, "euclidean"), K.hamming(x, x)).collect()
    for k, r in enumerate(got):
        u, v = a[k], b[k]
        d = np.linalg.norm(u - v)
        assert np.allclose(r, [u @ v, u @ v / np.linalg.norm(u) / np.linalg.norm(v), d, np.abs(u - v).sum(), np.linalg.norm(u), 1 / (1 + d), 0])
    assert np.allclose(df.select(K.normalize(x)).first()[0], a[0] / np.linalg.norm(a[0]))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|Division by zero"):
        df.select(K.cosine(x, F.array(*[F.lit(0.0)] * 8))).collect()


def test_vector_operators(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [0.0, 1.0], "b"), (4, None, "b"), (5, [-1.0, 0.0], "b")], "id int, embedding array<double>, kind string")
    assert [r.id for r in vector.knn(df, [1.0, 0.0], 2, tie="id").collect()] == [1, 2]
    assert [r.id for r in vector.similarity_search(df, [1.0, 0.0], 0.0).collect()] == [1, 2, 3]
    near = vector.knn(df, [1.0, 0.0], 4, tie="id")
    assert {r.id for r in vector.diverse(near, "kind", 1, "distance", tie="id").collect()} == {1, 3}
    assert [r.id for r in vector.spread(near, "embedding", 0.5, 3, "distance").collect()] == [1, 3, 5]
    pairs = vector.similarity_join(df.where("id <> 4"), df.where("id <> 4"), ("embedding", "embedding"), 0.9, [1.0, 1.0], ("id", "id"))
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == {(1, 1), (2, 2), (3, 3), (5, 5), (1, 2), (2, 1)}
    assert vector.approximate_knn(df.where("id <> 4"), [1.0, 0.0], 1, "embedding").first().id == 1
    for bad in (lambda: vector.knn(df, [1.0], 0), lambda: vector.similarity_search(df, [1.0], 2.0), lambda: vector.vector_column(df.select("id"))):
        with pytest.raises(VectorError):
            bad()
    maps = spark.range(1).select(vector.sparse_cosine(F.create_map(F.lit(1), F.lit(3.0), F.lit(2), F.lit(4.0)), F.create_map(F.lit(2), F.lit(2.0))))
    assert maps.first()[0] == pytest.approx(0.8)
    late = spark.range(1).select(vector.late_interaction(F.array(F.array(F.lit(1.0), F.lit(0.0))), F.array(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(5.0), F.lit(1.0)))))
    assert late.first()[0] == 5.0


def test_similarity_join_compares_blocks(spark, monkeypatch):
    """All pairs of 3,000 vectors, whole and with the kernel's digits, in a fraction of the time that rows take one by one."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(3000, 64)).astype(np.float32)
    m[7], m[11], m[12, 3], m[13, 0] = m[5], 2 * m[6], np.nan, 1e30
    monkeypatch.setattr(vector, "BLOCK", 700)
    rows = [(k, x.tolist()) for k, x in enumerate(m)] + [(3000, None), (3001, [None] * 64)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    start = time.monotonic()
    got = vector.similarity_join(df, df.withColumnRenamed("id", "k"), ("v", "v"), 0.35, m[0].tolist(), ("id", "k")).collect()
    assert time.monotonic() - start < 60
    d = m.astype(float)
    cos = d @ d.T / np.linalg.norm(d, axis=1)[:, None] / np.linalg.norm(d, axis=1)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(~(cos < 0.35)), strict=True)}
    assert len(got) == len(want) and {(r.left_id, r.right_id) for r in got} == want
    assert (12, 2999) in want and (2999, 12) in want  # a similarity that is no number is above all numbers, as in SQL
    some = spark.createDataFrame([(i, j, d[i].tolist(), d[j].tolist()) for i, j in sorted(want)[:200]], "i int, j int, a array<double>, b array<double>")
    digits = {(r.i, r.j): r.c for r in some.select("i", "j", K.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    held = {(r.left_id, r.right_id): r.similarity for r in got}
    assert all(held[k] == c or c != c for k, c in digits.items())
    same = vector.similarity_join(df.where("id < 12"), df.where("id < 12"), ("v", "v"), 1.0 - 1e-12, m[5].tolist(), ("id", "id"))
    assert {(r.left_id, r.right_id) for r in same.collect() if r.left_id < r.right_id} == {(5, 7), (6, 11)}


@settings(max_examples=20, deadline=None)
@given(st.tuples(st.floats(-3, 3), st.floats(-3, 3)), st.tuples(st.floats(-3, 3), st.floats(-3, 3)))
def test_ring_bound_of_the_proximity_join(p, q):
    """Points' distances to the apex differ by at most their distance."""
    x = lambda v: math.sqrt(1 + v[0] ** 2 + v[1] ** 2)
    d = math.acosh(max(1.0, x(p) * x(q) - p[0] * q[0] - p[1] * q[1]))
    assert abs(math.acosh(x(p)) - math.acosh(x(q))) <= d + 1e-6


def test_geometry(spark):
    df = spark.createDataFrame([(1, (1.0, 0.0, 0.0)), (2, (math.sqrt(1.01), 0.1, 0.0)), (3, (math.sqrt(2.0), 1.0, 0.0)), (4, None)], "id int, position struct<x:double,y:double,z:double>")
    got = {r.id: r.distance_from_center for r in geometry.within_radius(df, (1.0, 0.0, 0.0), 0.5).collect()}
    assert got[1] == pytest.approx(math.acosh(1.00001)) and got[2] == pytest.approx(math.acosh(math.sqrt(1.01))) and len(got) == 2
    assert [r.id for r in geometry.near_positions(df, (1.0, 0.0, 0.0), 2).collect()] == [1, 2]
    p = F.col("position")
    assert [r.id for r in geometry.contains(df, p, K.origin()).collect()] == [1, 2]
    assert [r.id for r in geometry.intersects(df, p, K.origin()).collect()] == [1, 2, 3]
    assert geometry.in_polygon(df, [(-1.0, -1.0), (0.5, -1.0), (0.5, 1.0), (-1.0, 1.0)]).count() == 2
    with pytest.raises(GeometricError):
        geometry.within_radius(df, (1.0, 0.0, 0.0), -1)


def test_cascades(spark):
    edges = spark.createDataFrame([("a", "t", "x", "2024-01-01", 1.0), ("b", "t", "x", "2024-01-03", 3.0), ("c", "t", "y", "2024-01-02", 1.0)], "from_id string, to_id string, type string, ts string, w double").withColumn("ts", F.to_timestamp("ts"))
    nodes = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 60.0), ("t", 5.0)], "id string, v double")

    def value(function, argument=None, through=("x",), direction="INCOMING", decay=None, rate=0.0, **options):
        got = cascade.gather(edges, nodes, Cascade(function, "v", through, direction, decay, rate, argument), "o", **options)
        return got.where("id = 't'").first().o

    assert [value(f) for f in ("SUM", "AVG", "MAX", "MIN", "COUNT")] == [30.0, 15.0, 20.0, 10.0, 2]
    assert value("SUM", through=()) == 90.0 and value("WEIGHTEDAVG", weight="w") == 17.5 and value("PERCENTILE", 50) == 15.0
    assert value("LATEST", timestamp="ts") == 20.0 and value("FIRST", timestamp="ts") == 10.0
    assert value("MOVINGMEAN", 1.0, timestamp="ts") == 20.0 and value("MOVINGMEDIAN", 5.0, (), timestamp="ts") == 20.0
    assert value("SUM", decay="EXPONENTIAL", rate=0.5, timestamp="ts") == pytest.approx(20 + 10 * math.exp(-1))
    assert value("SUM", decay="POWERLAW", rate=1.0, timestamp="ts") == pytest.approx(20 + 10 / 3)
    assert value("SUM", decay="LINEAR", rate=0.25, timestamp="ts") == pytest.approx(20 + 5)
    out = cascade.gather(edges, nodes, Cascade("SUM", "v", (), "OUTGOING"), "o")
    assert {r.id: r.o for r in out.collect()} == {"a": 5.0, "b": 5.0, "c": 5.0}


def test_temporal(spark):
    df = spark.createDataFrame([(k, "u", f"2024-01-01 00:{k:02d}:00", float(v)) for k, v in enumerate([1, 2, 4, 8])] + [(9, "w", "2024-01-01 00:00:00", None)], "id int, k string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    smooth = {r.id: r.s for r in temporal.exponential_smoothing(df, ["ts"], ["k"], "v", 0.5, "s").collect()}
    assert [smooth[k] for k in range(4)] == [1.0, 1.5, 2.75, 5.375] and (smooth[9] is None or math.isnan(smooth[9]))
    moving = {r.id: r.m for r in temporal.moving_average(df, ["ts"], ["k"], "v", 2, "m").collect()}
    assert moving[3] == 6.0
    sessions = temporal.session(df, "ts", "90 seconds", ["k"], [F.count(F.lit(1)).alias("n")])
    assert {(r.k, r.n) for r in sessions.collect()} == {("u", 4), ("w", 1)}
    right = df.select("k", (F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("ts"), F.col("v").alias("w"))
    joined = {r.id: r.right_w for r in temporal.asof_join(df, right, "k", "ts", ["w"]).collect()}
    assert (joined[0], joined[2]) == (None, 2.0)


def test_templates(spark):
    e = Engine(spark).register("t", spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 5, [0.0, 1.0])], "id string, n int, embedding array<double>"))
    assert templates.entities_by_property_range(e, "t", "n", low=2).count() == 1
    assert templates.vector_similarity_search(e, "t", [1.0, 0.0], 1).first().id == "a"
    assert templates.similarity_search_with_threshold(e, "t", [1.0, 0.0], 0.5).count() == 1
    assert templates.aggregate_by_property(e, "t", "id", "COUNT").count() == 2


def chain(spark, n):
    edges = [(f"n{k:02d}", f"n{k + 1:02d}", "to", 1.0 + k % 3) for k in range(n)]
    e = Engine(spark).register("relationships", spark.createDataFrame(edges, "from_id string, to_id string, type string, weight double"))
    return e.register("nodes", spark.createDataFrame([(f"n{k:02d}",) for k in range(n + 1)], "id string"))


def test_searches_go_on_until_they_settle(spark):
    e = chain(spark, 13)
    far = e.graph.shortest_path("n00", "n13").first()
    assert (far.distance, len(far.path)) == (13, 14)
    assert e.graph.shortest_path("n00", most=2).count() == 3
    assert {r.node_id: r.cost for r in e.graph.weighted_paths("n00").collect()}["n13"] == sum(1.0 + k % 3 for k in range(13))
    assert {r.component for r in e.graph.connected_components().collect()} == {"n00"}
    for cut in (lambda: e.graph.connected_components(most=1), lambda: e.graph.weighted_paths("n00", most=3)):
        with pytest.raises(GraphError):
            cut()
    with pytest.raises(GraphError, match="hop_cap"):
        e.sql("SELECT b FROM nodes TRAVERSE (a:nodes WHERE id = 'n00')-[:to*1..]->(b)")
    assert e.sql("SELECT b FROM nodes TRAVERSE (a:nodes WHERE id = 'n05')-[:to*1..]->(b)").count() == 8


def test_vectors_of_other_lengths_are_no_sum(spark):
    e = Engine(spark).register("t", spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0, 5.0])], "k int, v array<double>"))
    with pytest.raises(Exception, match="different lengths"):
        e.sql("SELECT k, VECTOR_SUM(v) AS s FROM t GROUP BY k").collect()


def test_proximity_join_meets_in_sectors(spark):
    rng = np.random.default_rng(8)
    rho, theta = rng.uniform(0, 4, 300), rng.uniform(-np.pi, np.pi, 300)
    y, z = np.sinh(rho) * np.cos(theta), np.sinh(rho) * np.sin(theta)
    p = np.stack([np.cosh(rho), y, z], 1)
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id int, x double, y double, z double")
    inner = np.outer(p[:, 0], p[:, 0]) - np.outer(y, y) - np.outer(z, z)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.arccosh(np.maximum(inner, 1.00001)) <= 0.4), strict=True)}
    got = [(r.left_id, r.right_id) for r in geometry.proximity_join(df, df, ("id", "id"), 0.4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_influence_converges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "from_id string, to_id string")
    nodes = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", None)], "id string, v double")
    got = {r.id: r.value for r in cascade.converge(edges, nodes, "v", 0.5).collect()}
    assert got["a"] == pytest.approx(4 / 3, abs=1e-5) and got["b"] == pytest.approx(2 / 3, abs=1e-5) and got["c"] == 0


def test_debounced_triggers_fire_once_a_key_across_batches(spark):
    e = Engine(spark)
    e.sql("CREATE STREAM s (k INTEGER, v STRING)")
    for k in (1, 2, 1):
        e.sql(f"PRODUCE INTO s (k, v) VALUES ({k}, 'x')")
    fired = []
    stream = e.streams.from_files(e.streams.get("s").path, e.streams.get("s").schema, files_per_trigger=1)
    e.streams.on(stream, F.col("v") == "x", lambda rows, _: fired.extend(r.k for r in rows.collect()), "k")
    assert sorted(fired) == [1, 2]


def test_correlated_subqueries_do_not_see_the_wrong_column(spark):
    e = Engine(spark)
    e.register("a", spark.createDataFrame([(1, "x"), (2, "y")], "k long, id string")).register("b", spark.createDataFrame([(1, 5.0), (3, 7.0)], "k long, v double"))
    assert [r[0] for r in e.sql("SELECT a.id AS id FROM a WHERE EXISTS (SELECT v FROM b WHERE b.k = a.k)").collect()] == ["x"]
    assert [r[0] for r in e.sql("SELECT a.id AS id FROM a WHERE NOT EXISTS (SELECT v FROM b WHERE b.k = a.k)").collect()] == ["y"]
    assert sorted(tuple(r) for r in e.sql("SELECT a.id AS id, (SELECT MAX(b.v) AS m FROM b WHERE b.k = a.k) AS m FROM a").collect()) == [("x", 5.0), ("y", None)]
    assert e.sql("SELECT * FROM a WHERE EXISTS (SELECT v FROM b WHERE b.k = a.k)").columns == ["k", "id"]


def test_graph_queries_without_sql_take_all_orders(spark):
    from polystrata import queries

    folder = "/root/testdata/sf0.001"
    o, lines = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("orders", "lineitem"))
    edges = {(f"c{r[0]}", f"s{r[1]}") for r in o.join(lines, o.o_orderkey == lines.l_orderkey).select("o_custkey", "l_suppkey").distinct().collect()}
    assert {r.id for r in queries.QUERIES["graph_communities"](spark, folder).collect()} == {x for e in edges for x in e}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    s, t = min(a for a, _ in edges), max(b for _, b in edges)
    want = [(s, t)] if t in near[s] else []
    want += [(s, x, y, t) for x in near[s] - {t} for y in near[x] - {s} if t in near[y]]
    assert sorted(tuple(r.path) for r in queries.QUERIES["graph_simple_paths"](spark, folder).collect()) == sorted(want)
