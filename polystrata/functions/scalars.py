"""Scalar and aggregate functions of the language, by upper-case name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels as K

Arity = tuple[int, int]
_ANY = 99


def _substring(s: Column, start: Column, length: Column | None = None) -> Column:
    return F.substr(s, start, length) if length is not None else F.substr(s, start)


def time_bucket(ts: Column, seconds: Column) -> Column:
    """Start of the bucket of ``seconds`` that ``ts`` lies in, from the epoch on."""
    step = seconds.cast("long")
    return F.timestamp_seconds(F.floor(F.unix_micros(ts.cast("timestamp")) / (step * F.lit(1_000_000).cast("long"))) * step)


def time_diff(unit: Column, a: Column, b: Column) -> Column:
    """Whole seconds, minutes, hours or days from ``a`` to ``b``."""
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    per = F.when(unit == "second", 1_000_000).when(unit == "minute", 60_000_000).when(unit == "hour", 3_600_000_000).when(unit == "day", 86_400_000_000)
    return F.floor(micros / per).cast("long")


SCALARS: dict[str, tuple[Arity, Callable[..., Column]]] = {
    "UPPER": ((1, 1), F.upper),
    "LOWER": ((1, 1), F.lower),
    "TRIM": ((1, 1), F.trim),
    "LENGTH": ((1, 1), F.length),
    "LEN": ((1, 1), F.length),
    "OCTET_LENGTH": ((1, 1), F.octet_length),
    "SUBSTRING": ((2, 3), _substring),
    "SUBSTR": ((2, 3), _substring),
    "CONCAT": ((1, _ANY), lambda *a: F.concat(*a)),
    "REPLACE": ((3, 3), lambda a, b, c: F.replace(a, b, c)),
    "COALESCE": ((1, _ANY), lambda *a: F.coalesce(*a)),
    "NULLIF": ((2, 2), F.nullif),
    "ABS": ((1, 1), F.abs),
    "ROUND": ((1, 2), lambda x, n=None: F.round(x, n) if n is not None else F.round(x)),
    "FLOOR": ((1, 1), F.floor),
    "CEIL": ((1, 1), F.ceil),
    "SQRT": ((1, 1), F.sqrt),
    "POW": ((2, 2), F.pow),
    "POWER": ((2, 2), F.pow),
    "MOD": ((2, 2), lambda a, b: a % b),
    "EXP": ((1, 1), F.exp),
    "LOG": ((1, 1), F.ln),
    "LN": ((1, 1), F.ln),
    "SIGN": ((1, 1), F.signum),
    "GREATEST": ((2, _ANY), lambda *a: F.greatest(*a)),
    "LEAST": ((2, _ANY), lambda *a: F.least(*a)),
    "PI": ((0, 0), F.pi),
    "RAND": ((0, 0), F.rand),
    "UUID": ((0, 0), lambda: F.expr("uuid()")),
    "NOW": ((0, 0), F.current_timestamp),
    "CURRENT_TIMESTAMP": ((0, 0), F.current_timestamp),
    "CURRENT_DATE": ((0, 0), F.current_date),
    "CURRENT_TIME": ((0, 0), lambda: F.date_format(F.current_timestamp(), "HH:mm:ss")),
    "DATE": ((1, 1), F.to_date),
    "DATE_TRUNC": ((2, 2), lambda unit, ts: F.call_function("date_trunc", unit, ts)),
    "INTERVAL": ((2, 2), lambda n, unit: F.make_dt_interval(F.when(unit == "day", n).otherwise(0).cast("int"), F.when(unit == "hour", n).otherwise(0).cast("int"), F.when(unit == "minute", n).otherwise(0).cast("int"), F.when(unit == "second", n).otherwise(0).cast("decimal(18,6)"))),
    "TIME_BUCKET": ((2, 2), time_bucket),
    "TIME_DIFF": ((3, 3), time_diff),
    "EXTRACT_TIME": ((2, 2), lambda part, ts: F.when(part == "year", F.year(ts)).when(part == "month", F.month(ts)).when(part == "day", F.dayofmonth(ts)).when(part == "hour", F.hour(ts)).when(part == "minute", F.minute(ts)).when(part == "second", F.second(ts)).cast("long")),
    "POSITION": ((3, 3), K.position),
    "VECTOR": ((1, _ANY), lambda *a: F.array(*[x.cast("double") for x in a])),
    "DOT_PRODUCT": ((2, 2), K.dot),
    "MAGNITUDE": ((1, 1), K.norm),
    "NORMALIZE": ((1, 1), K.normalize),
    "NEGATE": ((1, 1), lambda v: F.transform(K.doubles(v), lambda x: -x)),
    "ABSOLUTE": ((1, 1), lambda v: F.transform(K.doubles(v), F.abs)),
    "HYPERBOLIC_DISTANCE": ((2, 2), K.hyperbolic),
    "GEODESIC_DISTANCE": ((2, 2), K.hyperbolic),
    "WITHIN_RADIUS": ((3, 3), lambda p, q, r: K.hyperbolic(p, q) <= r),
    "IN_RADIUS": ((3, 4), lambda p, q, r, closed=None: K.hyperbolic(p, q) < r if closed is None else F.when(closed, K.hyperbolic(p, q) <= r).otherwise(K.hyperbolic(p, q) < r)),
    "CONTAINS": ((2, 2), lambda p, q: K.hyperbolic(p, q) < K.CONTAINED),
    "INTERSECTS": ((2, 2), lambda p, q: K.hyperbolic(p, q) < K.INTERSECTING),
    "PARSE_JSON": ((1, 1), F.parse_json),
    "JSON_VALUE": ((2, 2), lambda j, path: F.call_function("get_json_object", j, path)),
}


def vector_total(v: Column, dims: int) -> Column:
    """Element-wise sum of a group's vectors: one partial sum per dimension, so map sides combine."""
    return F.array(*[F.sum(F.get(v, F.lit(k)).cast("double")) for k in range(dims)])


def vector_mean(v: Column, dims: int) -> Column:
    return F.array(*[F.avg(F.get(v, F.lit(k)).cast("double")) for k in range(dims)])


def _centroid(p: Column) -> Column:
    """Mean position pushed back onto the hyperboloid (x*x - y*y - z*z = 1)."""
    x, y, z = F.avg(p["x"]), F.avg(p["y"]), F.avg(p["z"])
    scale = F.sqrt(F.greatest(x * x - y * y - z * z, F.lit(1e-12)))
    return K.position(x / scale, y / scale, z / scale)


AGGREGATES: dict[str, tuple[Arity, Callable[..., Column]]] = {
    "COUNT": ((0, 1), F.count),
    "SUM": ((1, 1), F.sum),
    "AVG": ((1, 1), F.avg),
    "MIN": ((1, 1), F.min),
    "MAX": ((1, 1), F.max),
    "ARRAY_AGG": ((1, 1), F.array_agg),
    "STRING_AGG": ((1, 2), lambda x, sep=None: F.array_join(F.array_sort(F.collect_list(x.cast("string"))), ",") if sep is None else F.call_function("array_join", F.array_sort(F.collect_list(x.cast("string"))), sep)),
    "GROUP_CONCAT": ((1, 1), lambda x: F.array_join(F.array_sort(F.collect_list(x.cast("string"))), ",")),
    "STDDEV": ((1, 1), F.stddev),
    "VARIANCE": ((1, 1), F.variance),
    "MEDIAN": ((1, 1), F.median),
    "PERCENTILE": ((2, 2), lambda x, p: F.percentile(x, p / 100)),
    "FIRST": ((2, 2), F.min_by),
    "LAST": ((2, 2), F.max_by),
    "VECTOR_SUM": ((1, 1), vector_total),
    "VECTOR_AVG": ((1, 1), vector_mean),
    "GEOMETRIC_MEAN": ((1, 1), _centroid),
    "MEASURE_SUM": ((1, 1), lambda m: F.sum(m["value"])),
    "MEASURE_AVG": ((1, 1), lambda m: F.avg(m["value"])),
}

WINDOWED = {"LAG": F.lag, "LEAD": F.lead}
RANKED = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}


def arity(name: str) -> Arity | None:
    for table in (SCALARS, AGGREGATES):
        if name in table:
            return table[name][0]
    if name in WINDOWED:
        return (1, 3)
    if name in RANKED:
        return (0, 0)
    return {"FIRST_VALUE": (1, 1), "LAST_VALUE": (1, 1), "MOVING_AVG": (2, 2)}.get(name)


def known_functions() -> list[str]:
    return [*SCALARS, *AGGREGATES, *WINDOWED, *RANKED, "FIRST_VALUE", "LAST_VALUE", "SIMILARITY", "DISTANCE", "CAST"]
