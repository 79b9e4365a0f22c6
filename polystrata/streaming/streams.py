"""Streams on Structured Streaming: declared streams, file sources, windows with watermarks, triggers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StreamError, close_names
from ..plans import nodes as N
from ..sources.schemas import spark_type

if TYPE_CHECKING:
    from ..engine import Engine


@dataclass
class Stream:
    name: str
    schema: T.StructType
    path: str


class Streams:
    """Declared streams of an engine: folders of parquet files that are appended to and read as streams."""

    def __init__(self, engine: Engine):
        self.engine, self.all = engine, {}

    def _folder(self) -> str:
        root = self.engine.spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not self.engine.spark.sparkContext.master.startswith("local"):
                raise StreamError("set spark.checkpoint.dir to a folder that all executors share")
            self._local = getattr(self, "_local", None) or tempfile.mkdtemp(prefix="polystrata-")
            root = self._local
        return f"{root.rstrip('/')}/streams"

    def get(self, name: str) -> Stream:
        if name not in self.all:
            raise StreamError(f"no stream {name}", close_names(name, self.all))
        return self.all[name]

    def _status(self, status: str, name: str) -> DataFrame:
        return self.engine.spark.range(1).select(F.lit(status).alias("status"), F.lit(name).alias("stream"))

    def run(self, s: N.StreamStatement, rows: list[list[Column]]) -> DataFrame:
        if s.action == "create":
            if s.name in self.all:
                if s.flag:
                    return self._status("exists", s.name)
                raise StreamError(f"stream {s.name} exists")
            schema = T.StructType([T.StructField(f.name, T._parse_datatype_string(spark_type(f)), not f.required) for f in s.fields])
            self.all[s.name] = Stream(s.name, schema, f"{self._folder()}/{s.name}-{uuid.uuid4().hex}")
            self.engine.spark.createDataFrame([], schema).write.parquet(self.all[s.name].path)
            return self._status("created", s.name)
        if s.action == "drop":
            if s.name not in self.all and s.flag:
                return self._status("absent", s.name)
            self.get(s.name)
            del self.all[s.name]
            return self._status("dropped", s.name)
        stream = self.get(s.name)
        if s.action == "describe":
            fields = [(f.name, f.dataType.simpleString(), not f.nullable) for f in stream.schema]
            return self.engine.spark.createDataFrame(fields, "field string, type string, required boolean")
        if s.action == "produce":
            kinds = {f.name: f.dataType for f in stream.schema}
            wrong = [c for c in s.columns if c not in kinds]
            if wrong:
                raise StreamError(f"stream {s.name} has no field {wrong[0]}", close_names(wrong[0], kinds))
            structs = [F.struct(*[v.cast(kinds[c]).alias(c) for c, v in zip(s.columns, r, strict=True)]) for r in rows]
            df = self.engine.spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))
            df = df.select(*[F.col(c) if c in s.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
            self.produce(s.name, df)
            return self._status("produced", s.name)
        return self.drain(self.read(s.name))

    # -- sources and sinks ------------------------------------------------

    def produce(self, name: str, df: DataFrame) -> None:
        """Append a batch."""
        df.write.mode("append").parquet(self.get(name).path)

    def read(self, name: str) -> DataFrame:
        stream = self.get(name)
        return self.engine.spark.readStream.schema(stream.schema).parquet(stream.path)

    def from_files(self, path: str, schema: T.StructType, format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
        reader = self.engine.spark.readStream.schema(schema).format(format)
        return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)

    def consume(self, stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
        """Run ``action`` on every micro-batch of what is there now, exactly once per ``checkpoint``."""
        at = checkpoint or f"{self._folder()}/checkpoint-{uuid.uuid4().hex}"
        stream.writeStream.foreachBatch(action).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()

    def drain(self, stream: DataFrame, mode: str = "append") -> DataFrame:
        """All that the stream yields now, as a batch DataFrame: written to files (append) or to an in-memory table (complete, update)."""
        tag = uuid.uuid4().hex
        at = f"{self._folder()}/checkpoint-{tag}"
        if mode == "append":
            out = f"{self._folder()}/out-{tag}"
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
            return self.engine.spark.read.schema(stream.schema).parquet(out)
        out = f"{self._folder()}/out-{tag}"

        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

        stream.writeStream.foreachBatch(keep).option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return self.engine.spark.read.schema(stream.schema).parquet(out)

    def insert_into(self, stream: DataFrame, path: str, mapping: dict[str, str] | None = None, partition_by: list[str] | None = None) -> None:
        """Consumer action: append what is there now to a table of files; ``mapping`` gives the table's columns from the stream's."""
        rows = stream.select(*[F.col(f"`{old}`").alias(new) for new, old in mapping.items()]) if mapping else stream
        writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{self._folder()}/checkpoint-{uuid.uuid4().hex}")
        (writer.partitionBy(*partition_by) if partition_by else writer).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    def forward(self, source: str, target: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Consumer action: what is in one declared stream now goes to another, through ``transform``."""
        rows = self.read(source)
        rows = transform(rows) if transform else rows
        into = self.get(target)
        missing = [f.name for f in into.schema if f.name not in rows.columns and not f.nullable]
        if missing:
            raise StreamError(f"stream {target} needs field {missing[0]}", close_names(missing[0], rows.columns))
        shaped = rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in into.schema])
        self.consume(shaped, lambda batch, _: batch.write.mode("append").parquet(into.path))

    # -- triggers ---------------------------------------------------------

    def on(self, stream: DataFrame, when: Column, action: Callable[[DataFrame, int], None], debounce_key: str | None = None) -> None:
        """A trigger: ``action`` gets the rows of each micro-batch for which ``when`` holds.

        Debounced, a key fires once: keys that fired are kept in the shared folder and left out of later batches.
        """
        fired = f"{self._folder()}/fired-{uuid.uuid4().hex}"
        kind = T.StructType([stream.schema[debounce_key]]) if debounce_key else None

        def fire(batch: DataFrame, serial: int) -> None:
            rows = batch.where(when)
            if kind is not None:
                before = batch.sparkSession.read.schema(kind).option("recursiveFileLookup", "true").parquet(fired)
                rows = rows.dropDuplicates([debounce_key]).join(before, debounce_key, "left_anti")
            rows = rows.persist()
            if rows.take(1):
                action(rows, serial)
                if kind is not None:
                    # a batch that is run again replaces its own keys
                    rows.select(debounce_key).write.mode("overwrite").parquet(f"{fired}/batch={serial}")
            rows.unpersist()

        if kind is not None:
            self.engine.spark.createDataFrame([], kind).write.parquet(f"{fired}/batch=none")

        self.consume(stream, fire)


def windowed(stream: DataFrame, ts: str, watermark: str, duration: str, slide: str | None, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Windowed aggregation with a watermark; NTZ timestamps are cast, as watermarks need instants."""
    df = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    w = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    out = df.groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), *[F.col(f"`{c}`") for c in out.columns if c != "w"])


def deduplicated(stream: DataFrame, ts: str, watermark: str, keys: list[str]) -> DataFrame:
    """First row per key within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def joined(left: DataFrame, right: DataFrame, keys: tuple[str, str], ts: tuple[str, str], watermark: str, within: str) -> DataFrame:
    """Stream-stream inner join on a key, right rows at most ``within`` after left ones."""
    a = left.withColumn(ts[0], F.col(ts[0]).cast("timestamp")).withWatermark(ts[0], watermark)
    b = right.withColumn(ts[1], F.col(ts[1]).cast("timestamp")).withWatermark(ts[1], watermark)
    return a.join(b, F.expr(f"{keys[0]} = {keys[1]} AND {ts[1]} >= {ts[0]} AND {ts[1]} <= {ts[0]} + INTERVAL {within}"))
