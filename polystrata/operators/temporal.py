"""Time series: buckets, lags, moving and exponential averages, windows, as-of joins."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tumbling(df: DataFrame, ts: str, duration: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """(start, *keys, aggs) per window of fixed length."""
    w = F.window(F.col(ts).cast("timestamp"), duration)
    return df.groupBy(w.alias("_w"), *keys).agg(*aggs).withColumn("start", F.col("_w.start")).drop("_w")


def sliding(df: DataFrame, ts: str, duration: str, slide: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    w = F.window(F.col(ts).cast("timestamp"), duration, slide)
    return df.groupBy(w.alias("_w"), *keys).agg(*aggs).withColumn("start", F.col("_w.start")).drop("_w")


def session(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """(start, end, *keys, aggs) per run of rows with pauses under ``gap``; end is the last row plus the gap."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    return df.groupBy(w.alias("_w"), *keys).agg(*aggs).withColumns({"start": F.col("_w.start"), "end": F.col("_w.end")}).drop("_w")


def landmark(df: DataFrame, ts: str, keys: list[str], column: str, name: str, tie: list[str] | None = None) -> DataFrame:
    """Running total from the first row on."""
    spec = Window.partitionBy(*keys).orderBy(ts, *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(column).over(spec))


def moving_average(df: DataFrame, order: list[str], keys: list[str], column: str, k: int, name: str) -> DataFrame:
    """Mean of the last k rows."""
    spec = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(k - 1), 0)
    return df.withColumn(name, F.avg(column).over(spec))


def exponential_smoothing(df: DataFrame, order: list[str], keys: list[str], column: str, alpha: float, name: str) -> DataFrame:
    """s(0) = x(0), s(t) = alpha x(t) + (1 - alpha) s(t-1), per key.

    Rows are sorted within partitions by (keys, order) and streamed: a key's
    state is one number, whatever its number of rows.  Values of a key are worked on
    64 at a time as a product with a triangular matrix; NULL repeats the last result.
    """
    steps = np.arange(64)
    weights = np.tril(alpha * (1 - alpha) ** np.maximum(steps[:, None] - steps[None, :], 0))
    fade = (1 - alpha) ** (steps + 1.0)

    def smooth(x: np.ndarray, state: float | None) -> np.ndarray:
        out = np.empty(len(x))
        if state is None and len(x):
            state = x[0]  # as if the series had been there before
        for low in range(0, len(x), 64):
            part = x[low : low + 64]
            out[low : low + 64] = weights[: len(part), : len(part)] @ part + fade[: len(part)] * state
            state = out[low + len(part) - 1]
        return out

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for frame in frames:
            values, out = frame[column].to_numpy(dtype="float64", na_value=np.nan), np.full(len(frame), np.nan)
            ends = np.flatnonzero((frame[keys].ne(frame[keys].shift()) & ~(frame[keys].isna() & frame[keys].shift().isna())).any(axis=1).to_numpy())
            bounds = np.unique(np.concatenate([[0], ends, [len(frame)]]))
            for low, high in itertools.pairwise(bounds.tolist()):
                key = tuple(None if pd.isna(k) else k for k in frame[keys].iloc[low])
                if key != last:
                    last, state = key, None
                has = np.flatnonzero(~np.isnan(values[low:high]))
                found = smooth(values[low:high][has], state)
                before = np.searchsorted(has, np.arange(high - low), side="right")
                filled = np.concatenate([[np.nan if state is None else state], found])[before]
                out[low:high] = filled
                state = None if high == low or np.isnan(filled[-1]) else float(filled[-1])
            yield frame.assign(**{name: out})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """Each left row with the right row of its key that is latest at or before it: one sort, no range join."""
    blank = [F.lit(None).cast(right.schema[c].dataType).alias(f"right_{c}") for c in columns]
    a = left.select("*", F.lit(1).alias("_side"), *blank)
    b = right.select(key, ts, F.lit(0).alias("_side"), *[F.col(c).alias(f"right_{c}") for c in columns])
    spec = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_side") == 0, F.struct(*[f"right_{c}" for c in columns])), ignorenulls=True).over(spec)
    out = a.unionByName(b, allowMissingColumns=True).withColumn("_held", held).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_held.right_{c}").alias(f"right_{c}") for c in columns])


def stream_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Temporal join: rows of one key whose timestamps lie at most ``seconds`` apart, met in buckets of that length."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(seconds * 1_000_000))
    a = left.withColumn("_b", bucket(left_ts))
    b = right.withColumn("_at", bucket(right_ts)).withColumn("_b", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1))).drop("_at")
    apart = F.abs(F.unix_micros(F.col(left_ts).cast("timestamp")) - F.unix_micros(F.col(right_ts).cast("timestamp")))
    return a.join(b, [key, "_b"]).where(apart <= seconds * 1_000_000).drop("_b")
