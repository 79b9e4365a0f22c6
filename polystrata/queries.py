"""Registered queries: each shows one operator of the engine on the test tables, with DuckDB SQL where SQL can express it.

Edges: an order's customer is tied to the suppliers of its lines; users of events
are tied to event types.  Points: y and z are the first two components of an
embedding and x = sqrt(1 + y*y + z*z), which lies on the hyperboloid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import templates
from .engine import Engine
from .functions import kernels as K
from .operators import cascade, geometry, temporal, vector
from .plans.nodes import Cascade
from .sources.catalog import Entity
from .streaming import streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the test tables, with edges, points and unit vectors as collections."""
    e = Engine(spark).load_folder(sf_dir, TABLES)
    return e


def _text(name: str, text: str, sql: str | None = None) -> None:
    """A query in the language, and its SQL (the same text if none is given)."""
    QUERIES[name] = lambda spark, d: engine(spark, d).sql(text)
    ORACLES[name] = sql or text


def _frame(name: str, sql: str | None = None):
    """Register a function of (engine) as a query."""

    def add(f: Callable[[Engine], DataFrame]):
        QUERIES[name] = lambda spark, d: f(engine(spark, d))
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -- scans, filters, projections ------------------------------------------------

_text("scan_star", "SELECT * FROM nation")
_text("scan_limit_total", "SELECT COUNT(*) AS total FROM orders LIMIT 5")
_text("project_alias", "SELECT c_custkey AS k, c_name AS n, c_acctbal * 2 AS b FROM customer")
_text("filter_cmp", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
_text("arith", "SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS b, p_size * 3 AS c, p_size / 4 AS d, p_size % 7 AS e, -p_size AS f, 2 * (p_size + 3) AS g FROM part")
_text("pred_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice > 950")
_text("pred_not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 40")
_text("pred_like", "SELECT c_custkey FROM customer WHERE c_name LIKE '%1_'")
_text("pred_not_like", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT LIKE 'B%'")
_text("pred_in", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
_text("pred_not_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
_text("pred_null", "SELECT user_id FROM events WHERE value IS NOT NULL AND props IS NOT NULL")
_text("pred_or_and", "SELECT p_partkey FROM part WHERE p_size = 1 OR p_size = 2 AND p_retailprice > 1000 OR NOT (p_size < 49)")
_text("case_coalesce", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS s, COALESCE(NULLIF(p_size, 1), 0) AS z FROM part")
_text("scalar_text", "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_name) AS l, LENGTH(c_name) AS n, SUBSTRING(c_name, 1, 4) AS s, CONCAT(c_name, '-', c_mktsegment) AS c, TRIM(c_mktsegment) AS t FROM customer")
_text("scalar_math", "SELECT s_suppkey, ABS(s_acctbal) AS a, FLOOR(s_acctbal) AS f, CEIL(s_acctbal) AS c, ROUND(SQRT(ABS(s_acctbal)), 6) AS q, POWER(2, s_nationkey) AS p, MOD(s_suppkey, 7) AS m FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, floor(s_acctbal)::BIGINT AS f, ceil(s_acctbal)::BIGINT AS c, round(sqrt(abs(s_acctbal)), 6) AS q, power(2, s_nationkey) AS p, s_suppkey % 7 AS m FROM supplier")
_text("scalar_log", "SELECT p_partkey, ROUND(LOG(p_retailprice), 6) AS l, ROUND(EXP(p_size / 50), 6) AS e FROM part", "SELECT p_partkey, round(ln(p_retailprice), 6) AS l, round(exp(p_size / 50), 6) AS e FROM part")
_text("scalar_date", "SELECT o_orderkey, DATE(o_orderdate) AS d, DATE_TRUNC('month', o_orderdate) AS m, EXTRACT_TIME('year', o_orderdate) AS y FROM orders", "SELECT o_orderkey, o_orderdate::DATE AS d, date_trunc('month', o_orderdate)::TIMESTAMP AS m, year(o_orderdate) AS y FROM orders")
_text("string_literal_operators", "SELECT o_orderkey FROM orders WHERE o_orderdate > '1995-06-17' AND o_orderpriority = '1-URGENT'", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-17' AND o_orderpriority = '1-URGENT'")

# -- aggregation ------------------------------------------------------------------

_text("group_agg", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty, ROUND(AVG(l_discount), 6) AS disc, MIN(l_tax) AS lo, MAX(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
_text("agg_global", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total, MIN(o_orderdate) AS first_day, MAX(o_orderkey) AS last_key FROM orders", "SELECT count(*) AS n, sum(o_totalprice) AS total, min(o_orderdate) AS first_day, max(o_orderkey) AS last_key FROM orders")
_text("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND SUM(o_totalprice) > 100000")
_text("agg_stats", "SELECT p_brand, ROUND(STDDEV(p_retailprice), 6) AS sd, ROUND(VARIANCE(p_size), 6) AS var, MEDIAN(p_size) AS med FROM part GROUP BY p_brand", "SELECT p_brand, round(stddev(p_retailprice), 6) AS sd, round(variance(p_size), 6) AS var, median(p_size) AS med FROM part GROUP BY p_brand")
_text("agg_count_distinct", "SELECT l_shipmode_flag, COUNT(DISTINCT l_suppkey) AS s FROM (SELECT l_returnflag AS l_shipmode_flag, l_suppkey FROM lineitem) t GROUP BY l_shipmode_flag")
_text("agg_string", "SELECT n_regionkey, STRING_AGG(n_name) AS names, GROUP_CONCAT(n_name) AS names2 FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_name, ',' ORDER BY n_name) AS names2 FROM nation GROUP BY n_regionkey")
_text("agg_expression", "SELECT o_orderstatus, ROUND(SUM(o_totalprice) / COUNT(*), 4) AS mean, SUM(o_totalprice * 0 + 1) AS ones FROM orders GROUP BY o_orderstatus ORDER BY SUM(o_totalprice) DESC")
_text("agg_percentile", "SELECT o_orderstatus, PERCENTILE(o_totalprice, 90) AS p90 FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.9) AS p90 FROM orders GROUP BY o_orderstatus")
_text("group_distinct", "SELECT DISTINCT n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t")

# -- joins ------------------------------------------------------------------------

_text("join_inner", "SELECT c.c_custkey AS k, c.c_name AS name, o.o_orderkey AS o FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 250000")
_text("join_left_null", "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
_text("join_right", "SELECT n.n_name AS n, s.s_suppkey AS s FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
_text("join_full", "SELECT a.n_name AS a, b.r_name AS b FROM nation a FULL OUTER JOIN region b ON a.n_nationkey = b.r_regionkey")
_text("join_theta", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
_text("join_chain3", "SELECT c.c_mktsegment AS seg, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice), 2) AS total FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY c.c_mktsegment")
_text("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
_text("join_flat_names", "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT n_nationkey AS n_n_nationkey, n_name AS n_n_name, n_regionkey AS n_n_regionkey, r_regionkey AS r_r_regionkey, r_name AS r_r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_text("join_semi", "SELECT c.c_custkey AS k FROM customer c SEMI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
_text("join_anti", "SELECT c.c_custkey AS k FROM customer c ANTI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")

# -- sort, limit, distinct, sets, subqueries --------------------------------------

_text("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_text("order_hidden", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
_text("distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
_text("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
_text("set_union", "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region")
_text("set_intersect", "SELECT c_nationkey AS x FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_text("set_except", "SELECT n_nationkey AS x FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
_text("subquery_from", "SELECT t.n AS n, COUNT(*) AS c FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY t.n")
_text("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.9 AS a FROM orders)")
_text("subquery_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
_text("top_k_slice", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS qty FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag ORDER BY n DESC LIMIT 3")

# -- windows and time -------------------------------------------------------------

_text("window_lag_lead", "SELECT event_id, LAG(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, LEAD(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")
_text("window_first_last", "SELECT event_id, FIRST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events")
_text("window_moving_avg", "SELECT event_id, ROUND(MOVING_AVG(value, 5) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS m FROM events", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS m FROM events")
_text("window_rank", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders")
_text("time_bucket", "SELECT TIME_BUCKET(ts, 3600) AS b, event_type, COUNT(*) AS n FROM events GROUP BY TIME_BUCKET(ts, 3600), event_type", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, event_type, count(*) AS n FROM events GROUP BY 1, 2")
_text("time_diff", "SELECT event_id, TIME_DIFF('minute', '2024-01-01 00:00:00', ts) AS m FROM events", "SELECT event_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000)::BIGINT AS m FROM events")
_frame("window_tumbling", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda e: temporal.tumbling(e.catalog.scan("events"), "ts", "10 minutes", ["event_type"], [F.count(F.lit(1)).alias("n")]))
_frame("window_sliding", "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start FROM events UNION ALL SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE FROM events) GROUP BY 1")(lambda e: temporal.sliding(e.catalog.scan("events"), "ts", "1 hour", "30 minutes", [], [F.count(F.lit(1)).alias("n")]))
_frame(
    "window_session",
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, count(*) AS n, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end" FROM b GROUP BY user_id, s""",
)(lambda e: temporal.session(e.catalog.scan("events"), "ts", "2 hours", ["user_id"], [F.count(F.lit(1)).alias("n")]))
_frame("window_landmark", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")(
    lambda e: temporal.landmark(e.catalog.scan("events"), "ts", ["user_id"], "value", "total", ["event_id"]).select("event_id", F.round("total", 4).alias("total"))
)
_frame(
    "exponential_smoothing",
    """WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT event_id, user_id, k, value::DOUBLE AS v FROM o WHERE k = 1 UNION ALL SELECT o.event_id, o.user_id, o.k, 0.3 * o.value + 0.7 * s.v FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
SELECT event_id, round(v + 1e-7, 4) AS smooth FROM s""",
)(lambda e: temporal.exponential_smoothing(e.catalog.scan("events").select("event_id", "user_id", "ts", "value"), ["ts", "event_id"], ["user_id"], "value", 0.3, "smooth").select("event_id", F.round(F.col("smooth") + 1e-7, 4).alias("smooth")))
_frame(
    "asof_join",
    "SELECT a.event_id, (SELECT max_by(b.value, (b.ts, b.event_id)) FROM events b WHERE b.event_type = 'view' AND b.user_id = a.user_id AND b.ts <= a.ts) AS right_value FROM events a WHERE a.event_type = 'purchase'",
)(lambda e: temporal.asof_join(e.catalog.scan("events").where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.catalog.scan("events").where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value")), "user_id", "ts", ["value"]).select("event_id", "right_value"))
_frame(
    "temporal_join",
    "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000",
)(lambda e: temporal.stream_join(e.catalog.scan("events").where("event_type = 'view'").select("user_id", F.col("event_id").alias("a_id"), F.col("ts").alias("at")), e.catalog.scan("events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b_id"), F.col("ts").alias("bt")), "user_id", "at", "bt", 3600).select("a_id", "b_id"))

# -- vectors ----------------------------------------------------------------------

_Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _query_vector(e: Engine) -> list[float]:
    return [float(x) for x in e.catalog.scan("embeddings").where("vec_id = 0").select("embedding").first()[0]]


def _vector_text(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: (e := engine(spark, d)).sql(text, q=_query_vector(e))
    ORACLES[name] = sql.replace("{q}", _Q0)


_vector_text("vector_cosine", "SELECT vec_id, ROUND(SIMILARITY(embedding, @q, 'cosine'), 6) AS s FROM embeddings", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {q}), 6) AS s FROM embeddings")
_vector_text("vector_euclidean", "SELECT vec_id, ROUND(DISTANCE(embedding, @q, 'euclidean'), 6) AS d FROM embeddings", "SELECT vec_id, round(list_distance(embedding::DOUBLE[], {q}), 6) AS d FROM embeddings")
_vector_text("vector_dot", "SELECT vec_id, ROUND(SIMILARITY(embedding, @q, 'dot'), 6) AS s FROM embeddings", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {q}), 6) AS s FROM embeddings")
_vector_text("vector_manhattan", "SELECT vec_id, ROUND(DISTANCE(embedding, @q, 'manhattan'), 6) AS d, ROUND(SIMILARITY(embedding, @q, 'manhattan'), 6) AS s FROM embeddings", "SELECT vec_id, round(d, 6) AS d, round(1 / (1 + d), 6) AS s FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding::DOUBLE[], {q}), lambda p: abs(p[1] - p[2]))) AS d FROM embeddings)")
_vector_text("vector_similar_to", "SELECT vec_id FROM embeddings WHERE embedding SIMILAR TO @q THRESHOLD 0.2", "SELECT vec_id FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {q}) >= 0.2")
_vector_text("vector_knn", "SELECT vec_id, ROUND(DISTANCE(embedding, @q, 'euclidean'), 6) AS d FROM embeddings ORDER BY DISTANCE(embedding, @q, 'euclidean'), vec_id LIMIT 10", "SELECT vec_id, round(list_distance(embedding::DOUBLE[], {q}), 6) AS d FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {q}), vec_id LIMIT 10")
_vector_text("vector_multi", "SELECT label, COUNT(*) AS n FROM embeddings WHERE SIMILARITY(embedding, @q, 'cosine') > 0.0 AND label < 5 GROUP BY label", "SELECT label, count(*) AS n FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {q}) > 0.0 AND label < 5 GROUP BY label")
_frame("vector_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x)) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS total FROM embeddings")(
    lambda e: vector.normalize(e.catalog.scan("embeddings")).select("vec_id", F.round(F.aggregate("normalized_vector", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))
)
_frame("vector_jaccard", "SELECT n_nationkey AS k, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS j FROM (SELECT n_nationkey, string_split(n_name, '') AS a, string_split('FRANCE', '') AS b FROM nation)")(
    lambda e: e.catalog.scan("nation").select(F.col("n_nationkey").alias("k"), F.round(K.jaccard(F.split("n_name", ""), F.split(F.lit("FRANCE"), "")), 6).alias("j"))
)
_frame("vector_search", "SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], " + _Q0 + ") AS s FROM embeddings) WHERE s >= 0.1")(lambda e: vector.similarity_search(e.catalog.scan("embeddings"), _query_vector(e), 0.1).select("vec_id", F.round("similarity", 6).alias("similarity")))
_text("vector_aggregate", "SELECT label, ROUND(MAGNITUDE(VECTOR_SUM(embedding)), 4) AS m, ROUND(MAGNITUDE(VECTOR_AVG(embedding)), 5) AS a FROM embeddings GROUP BY label", "SELECT label, round(sqrt(sum(s * s)), 4) AS m, round(sqrt(sum(a * a)), 5) AS a FROM (SELECT label, i, sum(x) AS s, avg(x) AS a FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY label")
_frame("vector_join", "SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")(
    lambda e: vector.similarity_join(e.catalog.scan("embeddings"), e.catalog.scan("embeddings"), ("embedding", "embedding"), 0.3, _query_vector(e), ("vec_id", "vec_id")).where("left_id < right_id").withColumn("similarity", F.round("similarity", 5))
)
_frame("vector_diverse", "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY list_distance(embedding::DOUBLE[], " + _Q0 + "), vec_id) AS r FROM embeddings) WHERE r <= 2")(
    lambda e: vector.diverse(e.catalog.scan("embeddings").withColumn("d", K.euclidean(F.col("embedding"), F.array(*[F.lit(x) for x in _query_vector(e)]))), "label", 2, "d", tie="vec_id").select("vec_id")
)

# -- hyperbolic geometry ----------------------------------------------------------

_POINTS = "(SELECT vec_id, label, sqrt(1 + y * y + z * z) AS x, y, z FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS y, embedding[2]::DOUBLE AS z FROM embeddings))"
_D0 = "acosh(greatest(x, 1 + 1e-5))"


def _points(e: Engine) -> Engine:
    y, z = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")
    rows = e.catalog.scan("embeddings").select("vec_id", "label", K.position(F.sqrt(1 + y * y + z * z), y, z).alias("position"))
    return e.register("points", rows)


def _geo_text(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: _points(engine(spark, d)).sql(text)
    ORACLES[name] = sql.replace("{p}", _POINTS).replace("{d0}", _D0)


_geo_text("geo_distance", "SELECT vec_id, ROUND(HYPERBOLIC_DISTANCE(position, origin), 6) AS d FROM points", "SELECT vec_id, round({d0}, 6) AS d FROM {p}")
_geo_text("geo_near", "SELECT vec_id FROM points WHERE position NEAR origin WITHIN 0.15", "SELECT vec_id FROM {p} WHERE {d0} <= 0.15")
_geo_text("geo_order_by", "SELECT vec_id FROM points ORDER BY position DISTANCE FROM origin, vec_id LIMIT 12", "SELECT vec_id FROM {p} ORDER BY {d0}, vec_id LIMIT 12")
_geo_text("geo_radius_open", "SELECT vec_id FROM points WHERE IN_RADIUS(position, origin, 0.2) AND label < 3", "SELECT vec_id FROM {p} WHERE {d0} < 0.2 AND label < 3")
_geo_text("geo_contains", "SELECT vec_id, CONTAINS(position, origin) AS c, INTERSECTS(position, origin) AS i FROM points", "SELECT vec_id, {d0} < 0.1 AS c, {d0} < 1.0 AS i FROM {p}")
_geo_text("geo_flat", "SELECT vec_id, ROUND(x * x - y * y - z * z, 6) AS one FROM points", "SELECT vec_id, round(x * x - y * y - z * z, 6) AS one FROM {p}")
_frame("geo_within_radius", f"SELECT vec_id, round({_D0}, 6) AS distance_from_center FROM {_POINTS} WHERE {_D0} <= 0.25")(lambda e: geometry.within_radius(_points(e).catalog.scan("points"), (1.0, 0.0, 0.0), 0.25).select("vec_id", F.round("distance_from_center", 6).alias("distance_from_center")))
_frame("geo_near_positions", f"SELECT vec_id, round({_D0}, 6) AS distance FROM {_POINTS} ORDER BY {_D0}, vec_id LIMIT 20")(lambda e: geometry.near_positions(_points(e).catalog.scan("points"), (1.0, 0.0, 0.0), 20, "vec_id").select("vec_id", F.round("distance", 6).alias("distance")))
_PAIR = "acosh(greatest(a.x * b.x - a.y * b.y - a.z * b.z, 1 + 1e-5))"
_frame("geo_proximity_join", f"SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({_PAIR}, 5) AS distance FROM {_POINTS} a JOIN {_POINTS} b ON a.vec_id < b.vec_id AND {_PAIR} <= 0.02")(
    lambda e: geometry.proximity_join(_points(e).catalog.scan("points"), e.catalog.scan("points"), ("vec_id", "vec_id"), 0.02).where("left_id < right_id").withColumn("distance", F.round("distance", 5))
)
_geo_text("geo_centroid", "SELECT label, ROUND(HYPERBOLIC_DISTANCE(GEOMETRIC_MEAN(position), origin), 4) AS d FROM points GROUP BY label", "SELECT label, round(acosh(greatest(avg(x) / sqrt(avg(x) * avg(x) - avg(y) * avg(y) - avg(z) * avg(z)), 1 + 1e-5)), 4) AS d FROM {p} GROUP BY label")

# -- graphs -----------------------------------------------------------------------

#: Customers buy from suppliers: one edge for each pair that shares an order line.
_EDGES = "(SELECT DISTINCT 'c' || c_custkey AS from_id, 's' || l_suppkey AS to_id, 'buys' AS type FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey)"
_UNDIRECTED = f"(SELECT from_id AS s, to_id AS t FROM {_EDGES} UNION SELECT to_id, from_id FROM {_EDGES})"


def _graph(e: Engine) -> Engine:
    """The graph over all orders, with customers and suppliers as collections."""
    c, o, lines = (e.catalog.scan(t) for t in ("customer", "orders", "lineitem"))
    rows = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    edges = rows.select(F.concat(F.lit("c"), "c_custkey").alias("from_id"), F.concat(F.lit("s"), "l_suppkey").alias("to_id"), F.lit("buys").alias("type")).distinct()
    e.register("relationships", edges)
    e.register("buyers", c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("nation")))
    e.register("sellers", e.catalog.scan("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))
    return e


def _graph_text(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: _graph(engine(spark, d)).sql(text)
    ORACLES[name] = sql


def _rounds_sql(start: str, step: str, rounds: int) -> str:
    """Rounds over neighbours (w: the node, n: its neighbours) as DuckDB SQL; 12 are enough where paths are short."""
    out = [f"u AS MATERIALIZED {_UNDIRECTED}", f"r0 AS MATERIALIZED ({start})"]
    for k in range(rounds):
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT w.id AS id, {step} AS v FROM r{k} w JOIN u ON w.id = u.s JOIN r{k} n ON n.id = u.t GROUP BY w.id)")
    return "WITH " + ", ".join(out)


_graph_text("graph_one_hop", "SELECT a, b, r FROM buyers TRAVERSE (a:buyers)-[r:buys]->(b:sellers)", f"SELECT from_id AS a, to_id AS b, 'path_depth_1' AS r FROM {_EDGES}")
_graph_text("graph_incoming", "SELECT a, b FROM sellers TRAVERSE (a:sellers)<-[r:buys]-(b:buyers)", f"SELECT to_id AS a, from_id AS b FROM {_EDGES}")
_graph_text(
    "graph_two_hops",
    "SELECT a, b, r FROM buyers TRAVERSE (a:buyers WHERE nation = 3)-[r:buys*1..2]-(b)",
    f"""WITH u AS {_UNDIRECTED}, st AS (SELECT 'c' || c_custkey AS a FROM customer WHERE c_nationkey = 3), h1 AS (SELECT DISTINCT a, t AS b FROM st JOIN u ON a = s),
h2 AS (SELECT DISTINCT a, t AS b FROM h1 JOIN u ON b = s WHERE t <> a AND (a, t) NOT IN (SELECT (a, b) FROM h1))
SELECT a, b, 'path_depth_1' AS r FROM h1 UNION ALL SELECT a, b, 'path_depth_2' FROM h2""",
)
_graph_text("graph_optional", "SELECT a, b FROM buyers TRAVERSE (a:buyers)-[r:buys?]->(b)", f"SELECT 'c' || c_custkey AS a, to_id AS b FROM customer LEFT JOIN {_EDGES} ON from_id = 'c' || c_custkey")
_graph_text("graph_patterns", "SELECT a, c, b FROM buyers TRAVERSE (a:buyers WHERE nation < 2)-[:buys]->(b), (c:buyers WHERE nation < 2)-[:buys]->(b)", f"WITH n AS (SELECT from_id, to_id FROM {_EDGES} JOIN customer ON from_id = 'c' || c_custkey WHERE c_nationkey < 2) SELECT x.from_id AS a, y.from_id AS c, x.to_id AS b FROM n x JOIN n y ON x.to_id = y.to_id")
_frame("graph_degree", f"SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT from_id AS id, 1 AS o, 0 AS i FROM {_EDGES} UNION ALL SELECT to_id, 0, 1 FROM {_EDGES}) GROUP BY id")(lambda e: _graph(e).graph.degree_centrality().drop("centrality"))
_frame("graph_components", _rounds_sql("SELECT s AS id, min(s) AS v FROM u GROUP BY s", "least(any_value(w.v), min(n.v))", 12) + " SELECT id, v AS component FROM r12")(lambda e: _graph(e).graph.connected_components())
_frame("graph_shortest_path", _rounds_sql(f"SELECT s AS id, CASE WHEN s = (SELECT min(from_id) FROM {_EDGES}) THEN 0 END AS v FROM u GROUP BY s", "least(any_value(w.v), min(n.v) + 1)", 12) + " SELECT id AS node_id, v AS distance FROM r12 WHERE v IS NOT NULL")(
    lambda e: _graph(e).graph.shortest_path(e.graph.edges().agg(F.min("from_id")).first()[0], direction="both").select("node_id", "distance")
)


def _pagerank_sql(rounds: int) -> str:
    steps = [f"e AS (SELECT DISTINCT from_id, to_id FROM {_EDGES})", "v AS (SELECT from_id AS id FROM e UNION SELECT to_id FROM e)", "n AS (SELECT count(*)::DOUBLE AS n FROM v)", "d AS (SELECT from_id, count(*) AS d FROM e GROUP BY 1)", "r0 AS (SELECT id, 1 / n AS r FROM v, n)"]
    for k in range(rounds):
        steps.append(f"g{k} AS (SELECT to_id, sum(r / d) AS g FROM e JOIN d USING (from_id) JOIN r{k} ON id = from_id GROUP BY 1)")
        steps.append(f"r{k + 1} AS (SELECT v.id, 0.15 / n + 0.85 * (coalesce(g, 0) + (1 - (SELECT coalesce(sum(g), 0) FROM g{k})) / n) AS r FROM n, v LEFT JOIN g{k} ON v.id = to_id)")
    return "WITH " + ", ".join(steps) + f" SELECT id, round(r, 9) AS rank FROM r{rounds}"


_frame("graph_pagerank", _pagerank_sql(4))(lambda e: _graph(e).graph.pagerank(4).select("id", F.round("rank", 9).alias("rank")))
def _communities_sql(rounds: int) -> str:
    steps = [f"u AS MATERIALIZED {_UNDIRECTED}", "r0 AS (SELECT DISTINCT s AS id, s AS v FROM u)"]
    for k in range(rounds):
        steps.append(f"c{k} AS (SELECT u.t AS id, r.v AS v, count(*) AS c FROM u JOIN r{k} r ON u.s = r.id GROUP BY 1, 2)")
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT id, min_by(v, (-c, v)) AS v FROM c{k} GROUP BY id)")
    return "WITH " + ", ".join(steps) + f" SELECT id, v AS community FROM r{rounds}"


_frame("graph_communities", _communities_sql(3))(lambda e: _graph(e).graph.label_propagation(3))
_frame(
    "graph_simple_paths",
    f"""WITH u AS MATERIALIZED {_UNDIRECTED}, e AS (SELECT min(from_id) AS a, max(to_id) AS z FROM {_EDGES}),
p1 AS (SELECT [a, z] AS path FROM e JOIN u ON s = a AND t = z),
p3 AS (SELECT [a, x.t, y.t, z] AS path FROM e JOIN u x ON x.s = a JOIN u y ON y.s = x.t JOIN u q ON q.s = y.t AND q.t = z WHERE x.t <> z AND y.t <> a AND y.t <> z)
SELECT path, len(path) - 1 AS length FROM p1 UNION ALL SELECT path, len(path) - 1 FROM p3""",
)(lambda e: _graph(e).graph.simple_paths(*e.graph.edges().agg(F.min("from_id"), F.max("to_id")).first(), most=3, direction="both"))

# -- cascades ---------------------------------------------------------------------

_BUYS = "(SELECT 'o' || o_orderkey AS from_id, 'c' || o_custkey AS to_id, 'placed_by' AS type, o_orderdate AS ts, o_totalprice / 1000 AS weight, o_totalprice AS v FROM orders)"


def _cascade(name: str, spec: Cascade, sql: str, had: str = "true", **options) -> None:
    def run(e: Engine) -> DataFrame:
        o = e.catalog.scan("orders")
        edges = o.select(F.concat(F.lit("o"), "o_orderkey").alias("from_id"), F.concat(F.lit("c"), "o_custkey").alias("to_id"), F.lit("placed_by").alias("type"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 1000).alias("weight"))
        nodes = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
        return cascade.gather(edges, nodes, spec, "value", **options).select("id", F.round(F.col("value") + 1e-6, 3).alias("value"))

    _frame(name, f"SELECT to_id AS id, round({sql} + 1e-6, 3) AS value FROM {_BUYS} GROUP BY to_id HAVING {had}")(run)


_AGE = "((epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(ts)) / 86400000000.0)"
_THROUGH = ("placed_by",)
_cascade("cascade_sum", Cascade("SUM", "price", _THROUGH, "INCOMING"), "sum(v)")
_cascade("cascade_avg", Cascade("AVERAGE", "price", _THROUGH, "INCOMING"), "avg(v)")
_cascade("cascade_max", Cascade("MAX", "price", (), "INCOMING"), "max(v)")
_cascade("cascade_weighted", Cascade("WEIGHTEDAVG", "price", _THROUGH, "INCOMING"), "sum(v * weight) / sum(weight)", weight="weight")
_cascade("cascade_percentile", Cascade("PERCENTILE", "price", _THROUGH, "INCOMING", argument=95), "quantile_cont(v, 0.95)")
_cascade("cascade_decay_exp", Cascade("SUM", "price", _THROUGH, "INCOMING", "EXPONENTIAL", 0.001), f"sum(v * exp(-0.001 * {_AGE}))", timestamp="ts")
_cascade("cascade_decay_power", Cascade("AVG", "price", _THROUGH, "INCOMING", "POWERLAW", 0.5), f"sum(v * pow(1 + {_AGE}, -0.5)) / sum(pow(1 + {_AGE}, -0.5))", timestamp="ts")
_cascade("cascade_decay_linear", Cascade("SUM", "price", _THROUGH, "INCOMING", "LINEAR", 0.0002), f"sum(v * greatest(0, 1 - 0.0002 * {_AGE}))", timestamp="ts")
_frame("cascade_latest", f"SELECT to_id AS id, max_by(v, (ts, v)) AS value FROM {_BUYS} GROUP BY to_id")(lambda e: cascade.gather(e.catalog.scan("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("from_id"), F.concat(F.lit("c"), "o_custkey").alias("to_id"), F.lit("placed_by").alias("type"), F.col("o_orderdate").alias("ts")), e.catalog.scan("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), Cascade("LATEST", "price", _THROUGH, "INCOMING"), "value", timestamp="ts"))

_cascade("cascade_min", Cascade("MIN", "price", _THROUGH, "INCOMING"), "min(v)")
_cascade("cascade_count", Cascade("COUNT", "price", _THROUGH, "INCOMING"), "count(v)")
_cascade("cascade_both", Cascade("SUM", "price", _THROUGH, "BOTH"), "sum(v)")
_cascade("cascade_moving_mean", Cascade("MOVINGMEAN", "price", _THROUGH, "INCOMING", argument=900.0), f"avg(v) FILTER (WHERE {_AGE} <= 900)", timestamp="ts", had=f"count(*) FILTER (WHERE {_AGE} <= 900) > 0")
_cascade("cascade_moving_median", Cascade("MOVINGMEDIAN", "price", _THROUGH, "INCOMING", argument=900.0), f"median(v) FILTER (WHERE {_AGE} <= 900)", timestamp="ts", had=f"count(*) FILTER (WHERE {_AGE} <= 900) > 0")
_cascade("cascade_time_windowed", Cascade("TIMEWINDOWEDAVERAGE", "price", _THROUGH, "INCOMING", argument=300.0), f"avg(v) FILTER (WHERE {_AGE} <= 300)", timestamp="ts", had=f"count(*) FILTER (WHERE {_AGE} <= 300) > 0")
_cascade("cascade_first", Cascade("FIRST", "price", _THROUGH, "INCOMING"), "min_by(v, (ts, v))", timestamp="ts")


def _order_graph(e: Engine) -> Engine:
    o = e.catalog.scan("orders")
    e.register("relationships", o.select(F.concat(F.lit("o"), "o_orderkey").alias("from_id"), F.concat(F.lit("c"), "o_custkey").alias("to_id"), F.lit("placed_by").alias("type"), F.col("o_orderdate").alias("ts")))
    e.register("sales", o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("price")))
    return e.register("buyers", e.catalog.scan("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")))


_frame("cascade_propagate", f"SELECT from_id AS id, round(v, 3) AS value FROM {_BUYS} UNION ALL SELECT to_id, round(sum(v), 3) FROM {_BUYS} GROUP BY to_id")(
    lambda e: cascade.propagate(_order_graph(e).catalog.scan("relationships"), e.catalog.scan("sales"), "price", 1).select("id", F.round("value", 3).alias("value"))
)
_frame("cascade_distribute", f"SELECT to_id AS id, round(sum(v), 3) AS value FROM {_BUYS} GROUP BY to_id")(lambda e: cascade.distribute(_order_graph(e).catalog.scan("relationships"), e.catalog.scan("sales"), "price").select("id", F.round("value", 3).alias("value")))
_frame("cascade_schema", f"SELECT 'c' || c_custkey AS id, n, round(m + 1e-6, 3) AS m FROM customer LEFT JOIN (SELECT to_id, count(v) AS n, avg(v) AS m FROM {_BUYS} GROUP BY to_id) ON to_id = 'c' || c_custkey")(
    lambda e: (_order_graph(e), e.sql("CREATE SCHEMA buyers (id STRING REQUIRED, n INTEGER CASCADED AS AGGREGATE COUNT FROM price THROUGH placed_by INCOMING, m FLOAT CASCADED AS AGGREGATE AVG FROM price INCOMING)"), e.with_cascades("buyers", source="sales").select("id", "n", F.round(F.col("m") + 1e-6, 3).alias("m")))[-1]
)
_frame("geo_rectangle", f"SELECT vec_id FROM {_POINTS} WHERE y BETWEEN -0.1 AND 0.1 AND z BETWEEN 0 AND 0.2 AND x BETWEEN 1 AND 2")(lambda e: geometry.in_rectangle(_points(e).catalog.scan("points"), (1, -0.1, 0), (2, 0.1, 0.2)).select("vec_id"))
_frame("geo_polygon", f"SELECT vec_id FROM {_POINTS} WHERE y > 0 AND z > 0 AND y + z < 0.2")(lambda e: geometry.in_polygon(_points(e).catalog.scan("points"), [(0.0, 0.0), (0.2, 0.0), (0.0, 0.2)]).select("vec_id"))
_text("json_value", "SELECT event_id, JSON_VALUE(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")

# -- schemas, DML, builder, templates, streams ------------------------------------

_frame(
    "ddl_describe",
    """SELECT * FROM (VALUES (0, 'id', 'STRING', 'string', true, 'METADATA', 'regular', NULL, 'CLOSED'), (1, 'score', 'FLOAT', 'double', false, 'METADATA', 'regular', NULL, 'CLOSED'),
(2, 'tags', 'ARRAY(STRING)', 'array<string>', false, 'METADATA', 'regular', NULL, 'CLOSED'), (3, 'avg_price', 'FLOAT', 'double', false, 'METADATA', 'cascaded', 'AVERAGE', 'CLOSED'),
(4, 'born', 'TIMESTAMP', 'timestamp', false, 'METADATA', 'regular', NULL, 'CLOSED')) t(place, field, type, spark_type, required, scope, kind, aggregation, extensibility)""",
)(lambda e: (e.sql("CREATE SCHEMA topics (id STRING REQUIRED, score FLOAT, tags ARRAY(STRING), avg_price FLOAT CASCADED AS AGGREGATE AVERAGE FROM price THROUGH tagged_with INCOMING WITH DECAY EXPONENTIAL(0.5)) WITH EXTENSIBILITY CLOSED"), e.sql("ALTER SCHEMA topics ADD FIELD born TIMESTAMP OPTIONAL"), e.sql("DESCRIBE SCHEMA topics DETAILED"))[-1])
_frame("dml_insert", "SELECT * FROM region UNION ALL SELECT 5, 'ATLANTIS' UNION ALL SELECT 6, NULL")(lambda e: e.sql("INSERT INTO region (r_regionkey, r_name) VALUES (5, 'ATLANTIS'), (6, NULL)"))
_frame("dml_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'in one' ELSE n_name END AS n_name, n_regionkey FROM nation")(lambda e: e.sql("UPDATE nation SET n_name = 'in one' WHERE n_regionkey = 1"))
_frame("dml_delete", "SELECT * FROM nation WHERE NOT (n_regionkey = 1)")(lambda e: e.sql("DELETE FROM nation WHERE n_regionkey = 1"))
_frame("builder_query", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderpriority = '1-URGENT' GROUP BY o_orderstatus")(lambda e: e.builder().select("o_orderstatus", "COUNT(*) AS n").from_("orders").where_expr("o_totalprice > 1000").where_eq("o_orderpriority", "1-URGENT").group_by("o_orderstatus").run())
_frame("template_range", "SELECT * FROM part WHERE p_size >= 5 AND p_size <= 9")(lambda e: templates.entities_by_property_range(e, "part", "p_size", 5, 9))
_frame("template_aggregate", "SELECT p_brand, max(p_retailprice) AS value FROM part GROUP BY p_brand")(lambda e: templates.aggregate_by_property(e, "part", "p_brand", "max", "p_retailprice"))
_frame("template_label", "SELECT * FROM region")(lambda e: templates.entity_by_label(e, "region"))
_frame("udf_pandas", "SELECT p_partkey, p_retailprice * 1.1 AS v FROM part")(lambda e: (e.functions.register("markup", lambda s: s * 1.1, "pandas", "double"), e.sql("SELECT p_partkey, MARKUP(p_retailprice) AS v FROM part"))[-1])


def _event_stream(spark: SparkSession, d: str, e: Engine) -> DataFrame:
    # as a glob: a stream's plain path has to be a folder
    return e.streams.from_files(f"{d}/events.parque[t]", spark.read.parquet(f"{d}/events.parquet").schema)


def _stream(name: str, sql: str | None, f: Callable[[Engine, DataFrame, SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = lambda spark, d: (e := engine(spark, d)) and f(e, _event_stream(spark, d, e), spark, d)
    if sql:
        ORACLES[name] = sql


_stream("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2", lambda e, s, _, __: e.streams.drain(streams.windowed(s, "ts", "1 hour", "1 hour", None, ["event_type"], [F.count(F.lit(1)).alias("n")]), "complete"))
_stream("stream_filter", "SELECT event_id, value FROM events WHERE event_type = 'error'", lambda e, s, _, __: e.streams.drain(s.where("event_type = 'error'").select("event_id", "value")))
_stream("stream_dedup", "SELECT DISTINCT event_id FROM events", lambda e, s, _, __: e.streams.drain(streams.deduplicated(s, "ts", "60 days", ["event_id"]).select("event_id")))
_stream(
    "stream_join",
    "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR",
    lambda e, s, spark, d: e.streams.drain(streams.joined(s.where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("event_id").alias("a_id"), F.col("ts").alias("at")), _event_stream(spark, d, e).where("event_type = 'purchase'").select(F.col("user_id").alias("w"), F.col("event_id").alias("b_id"), F.col("ts").alias("bt")), ("u", "w"), ("at", "bt"), "60 days", "1 HOUR").select("a_id", "b_id")),
)
_frame("stream_produce_consume", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(k, v)")(lambda e: (e.sql("CREATE STREAM clicks (k INTEGER, v STRING)"), e.sql("PRODUCE INTO clicks (k, v) VALUES (1, 'a'), (2, 'b')"), e.sql("CONSUME FROM clicks"))[-1])


# -- subqueries that refer outwards, several groupings, frames by value -------------

_text("subquery_exists", "SELECT c.c_custkey AS k FROM customer c WHERE EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 480000)")
_text("subquery_not_exists", "SELECT c.c_custkey AS k FROM customer c WHERE NOT EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
_text("subquery_correlated_scalar", "SELECT o.o_orderkey AS k FROM orders o WHERE o.o_totalprice = (SELECT MAX(p.o_totalprice) AS m FROM orders p WHERE p.o_custkey = o.o_custkey)")
_text("subquery_correlated_in", "SELECT s.s_suppkey AS k FROM supplier s WHERE s.s_nationkey IN (SELECT c.c_nationkey FROM customer c WHERE c.c_acctbal < s.s_acctbal - 9000)")
_text("subquery_exists_plain", "SELECT r_name FROM region WHERE EXISTS (SELECT n_nationkey FROM nation WHERE n_nationkey = 24)")
_text("group_rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)")
_text("group_cube", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")
_text("group_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_text("window_range", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part")
_text("window_range_running", "SELECT p_partkey, SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM part")
_text("window_ranks", "SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part")
_text("order_nulls", "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 490000 ORDER BY o.o_orderkey DESC NULLS FIRST, c.c_custkey LIMIT 1300")
_text("order_nulls_last", "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 490000 ORDER BY o.o_orderkey NULLS LAST, c.c_custkey LIMIT 400")
_text("pred_is_null", "SELECT t.k AS k FROM (SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 490000) t WHERE t.o IS NULL")
_text("agg_count_column", "SELECT t.s AS s, COUNT(t.o) AS n, COUNT(*) AS a FROM (SELECT c.c_mktsegment AS s, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 490000) t GROUP BY t.s")
_text("agg_array", "SELECT n_regionkey, ARRAY_AGG(DISTINCT n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_agg(DISTINCT n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_text("agg_string_separator", "SELECT n_regionkey, STRING_AGG(n_name, ' | ') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ' | ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_text("cast_types", "SELECT p_partkey, CAST(p_retailprice AS INTEGER) AS i, CAST(p_size AS STRING) AS s, CAST(p_size AS DOUBLE) AS d FROM part", "SELECT p_partkey, trunc(p_retailprice)::BIGINT AS i, p_size::VARCHAR AS s, p_size::DOUBLE AS d FROM part")
_text("scalar_constants", "SELECT r_regionkey, ROUND(PI(), 6) AS p, LENGTH(UUID()) AS u, RAND() < 1 AS r, CURRENT_TIMESTAMP() IS NOT NULL AS t, NOW() IS NOT NULL AS n FROM region", "SELECT r_regionkey, round(pi(), 6) AS p, 36 AS u, true AS r, true AS t, true AS n FROM region")
_text("scalar_interval", "SELECT event_id, ts + INTERVAL(2, 'hour') AS later FROM events", "SELECT event_id, ts + INTERVAL 2 HOUR AS later FROM events")
_text("auto_names", "SELECT COUNT(*), MAX(n_nationkey), n_regionkey FROM nation GROUP BY n_regionkey", 'SELECT count(*) AS "COUNT(*)", max(n_nationkey) AS "MAX(n_nationkey)", n_regionkey FROM nation GROUP BY n_regionkey')
_text("vector_build", "SELECT s_suppkey, MAGNITUDE(VECTOR(3 * s_nationkey, 4 * s_nationkey)) AS m, HYPERBOLIC_DISTANCE(POSITION(1, 0, 0), origin) < 0.005 AS o FROM supplier", "SELECT s_suppkey, 5.0::DOUBLE * s_nationkey AS m, true AS o FROM supplier")
_text("vector_unary", "SELECT vec_id, ROUND(DOT_PRODUCT(NEGATE(embedding), ABSOLUTE(embedding)), 5) AS d FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: -x * abs(x))), 5) AS d FROM embeddings")
_text("vector_hamming", "SELECT n_nationkey, DISTANCE(VECTOR(n_nationkey % 2, n_regionkey, 1), VECTOR(1, 2, 1), 'hamming') AS h FROM nation", "SELECT n_nationkey, (CASE WHEN n_nationkey % 2 = 1 THEN 0 ELSE 1 END + CASE WHEN n_regionkey = 2 THEN 0 ELSE 1 END)::DOUBLE AS h FROM nation")
_frame("scan_limit", "SELECT 7 AS n")(lambda e: e.catalog.scan_with_limit("orders", 7).agg(F.count(F.lit(1)).cast("int").alias("n")))
_frame("scan_entities", "SELECT * FROM (VALUES ('a', 30, 1.0::DOUBLE), ('b', 25, NULL)) t(id, age, x)")(lambda e: (e.add_entities("people", [Entity("a", {"age": 30}, (1.0, 0.0, 0.0)), Entity("b", {"age": 25})]), e.sql("SELECT id, age, x FROM people"))[-1])
_frame("scan_entity_type", "SELECT n_name FROM nation WHERE n_regionkey = 1")(lambda e: e.register("places", e.catalog.scan("nation").withColumn("_type", F.concat(F.lit("r"), F.col("n_regionkey")))).sql("SELECT n_name FROM places.r1"))
_frame("measure_aggregate", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY 1")(
    lambda e: e.register("measures", e.catalog.scan("orders").select("o_orderstatus", F.struct(F.col("o_totalprice").alias("value"), F.lit("EUR").alias("unit")).alias("m"))).sql("SELECT o_orderstatus, ROUND(MEASURE_SUM(m), 2) AS s, ROUND(MEASURE_AVG(m), 4) AS a FROM measures GROUP BY o_orderstatus")
)
_frame("fields_calculated", "SELECT p_partkey, p_retailprice * 2 AS twice, p_retailprice * 2 + p_size AS more, p_size + 1.0::DOUBLE AS up FROM part")(
    lambda e: (
        e.functions.register("raised", lambda x: x + F.lit(1.0)),
        e.sql("CREATE SCHEMA part (p_partkey INTEGER REQUIRED, twice FLOAT CALCULATED AS p_retailprice * 2, more FLOAT CALCULATED AS twice + p_size, up FLOAT COMPUTED AS RAISED(p_size))"),
        e.with_calculated("part").select("p_partkey", "twice", "more", "up"),
    )[-1]
)
_frame("template_near", f"SELECT vec_id, round({_D0}, 6) AS distance FROM {_POINTS} WHERE {_D0} <= 0.2")(lambda e: templates.entities_near_point(_points(e), "points", 1.0, 0.0, 0.0, 0.2).select("vec_id", F.round("distance", 6).alias("distance")))
_frame("template_within", f"SELECT vec_id FROM {_POINTS} WHERE {_D0} < 0.2")(lambda e: templates.entities_within_radius(_points(e), "points", (1.0, 0.0, 0.0), 0.2, closed=False).select("vec_id"))
_frame("template_similar", f"SELECT vec_id FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q0}) DESC, vec_id LIMIT 5")(lambda e: templates.vector_similarity_search(e, "embeddings", _query_vector(e), 5, tie="vec_id").select("vec_id"))
_frame("template_threshold", f"SELECT vec_id FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {_Q0}) >= 0.15")(lambda e: templates.similarity_search_with_threshold(e, "embeddings", _query_vector(e), 0.15).select("vec_id"))
_frame("template_traverse", f"SELECT from_id AS a, to_id AS b FROM {_EDGES}")(lambda e: templates.traverse_relationship(_graph(e), "buyers", "buys", "sellers").select("a", "b"))
_frame("vector_knn_operator", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q0}), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q0}), vec_id LIMIT 100")(lambda e: vector.knn(e.catalog.scan("embeddings"), _query_vector(e), 100, tie="vec_id").select("vec_id", F.round("distance", 6).alias("distance")))


def _spread_sql(k: int, apart: float) -> str:
    steps = [f"c0 AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_distance(embedding::DOUBLE[], {_Q0}) AS d FROM embeddings)"]
    for n in range(k):
        steps.append(f"b{n} AS MATERIALIZED (SELECT * FROM c{n} ORDER BY d, vec_id LIMIT 1)")
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.* FROM c{n} c, b{n} b WHERE list_distance(c.v, b.v) >= {apart})")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT vec_id FROM b{n}" for n in range(k))


_frame("vector_spread", _spread_sql(4, 1.35))(lambda e: vector.spread(e.catalog.scan("embeddings").withColumn("d", K.euclidean(F.col("embedding"), F.array(*[F.lit(x) for x in _query_vector(e)]))), "embedding", 1.35, 4, "d", "vec_id").select("vec_id"))
_frame("geo_geodesic", f"SELECT vec_id, round({_D0}, 6) AS distance FROM {_POINTS}")(lambda e: geometry.geodesic_distance(_points(e).catalog.scan("points"), F.col("position"), K.origin()).select("vec_id", F.round("distance", 6).alias("distance")))
_graph_text("graph_edge_where", "SELECT a, b FROM buyers TRAVERSE (a:buyers)-[r:buys WHERE to_id = 's1']->(b)", f"SELECT from_id AS a, to_id AS b FROM {_EDGES} WHERE to_id = 's1'")
_graph_text("graph_open_end", "SELECT b FROM buyers TRAVERSE (a:buyers WHERE id = 'c1')-[:buys*1..]-(b)", _rounds_sql("SELECT s AS id, CASE WHEN s = 'c1' THEN 0 END AS v FROM u GROUP BY s", "least(any_value(w.v), min(n.v) + 1)", 12) + " SELECT id AS b FROM r12 WHERE v > 0")
_frame("graph_weighted_paths", _rounds_sql(f"SELECT s AS id, CASE WHEN s = (SELECT min(from_id) FROM {_EDGES}) THEN 0 END AS v FROM u GROUP BY s", "least(any_value(w.v), min(n.v + 1 + (substr(u.s, 2)::INT + substr(u.t, 2)::INT) % 7))", 24) + " SELECT id AS node_id, v::DOUBLE AS cost FROM r24 WHERE v IS NOT NULL")(
    lambda e: (
        e.register("relationships", _graph(e).graph.edges().withColumn("weight", (1 + (F.substr("from_id", F.lit(2)).cast("int") + F.substr("to_id", F.lit(2)).cast("int")) % 7).cast("double"))),
        e.graph.weighted_paths(e.graph.edges().agg(F.min("from_id")).first()[0], direction="both"),
    )[-1]
)
_frame("graph_closeness", "WITH e AS (SELECT DISTINCT 'n' || c_nationkey AS s, 'r' || n_regionkey AS t FROM customer JOIN nation ON c_nationkey = n_nationkey), d AS (SELECT s AS id, count(*) OVER (PARTITION BY t) AS k FROM e) SELECT id, k::BIGINT AS reached, round(k / (1.0 + 2 * (k - 1)), 9) AS closeness FROM d UNION ALL SELECT t, count(*), 1.0 FROM e GROUP BY t")(
    lambda e: (
        e.register("relationships", e.catalog.scan("customer").join(e.catalog.scan("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("n"), "c_nationkey").alias("from_id"), F.concat(F.lit("r"), "n_regionkey").alias("to_id"), F.lit("in").alias("type")).distinct()),
        e.graph.closeness_centrality().withColumn("closeness", F.round("closeness", 9)),
    )[-1]
)
_frame("cascade_converge", f"SELECT from_id AS id, round(v + 1e-4, 2) AS value FROM {_BUYS} UNION ALL SELECT to_id, round(0.5 * avg(v) + 1e-4, 2) FROM {_BUYS} GROUP BY to_id")(
    lambda e: cascade.converge(_order_graph(e).catalog.scan("relationships"), e.catalog.scan("sales").unionByName(e.catalog.scan("buyers").withColumn("price", F.lit(0.0))), "price").join(_order_graph(e).catalog.scan("relationships").select(F.col("to_id").alias("id")).distinct().unionByName(e.catalog.scan("sales").select("id")), "id", "left_semi").select("id", F.round(F.col("value") + 1e-4, 2).alias("value"))
)


def _forwarded(e: Engine) -> DataFrame:
    e.sql("CREATE STREAM raw (k INTEGER, v STRING)")
    e.sql("CREATE STREAM loud (k INTEGER, v STRING)")
    e.sql("PRODUCE INTO raw (k, v) VALUES (1, 'a'), (2, 'b'), (3, NULL)")
    e.streams.forward("raw", "loud", lambda df: df.where("v IS NOT NULL").withColumn("v", F.upper("v")))
    return e.sql("CONSUME FROM loud")


_frame("stream_forward", "SELECT * FROM (VALUES (1, 'A'), (2, 'B')) t(k, v)")(_forwarded)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational, in one line: filter, group, sort, limit."""
    return QUERIES["top_k_slice"](spark, sf_dir)
