"""Shared plumbing of the corpus operators: text access, shared scratch tables, batching.

Every operator reads ``(id, text)`` by name and takes a NULL text as the empty
string.  Texts cross to Python as UTF-8 *bytes* (Arrow binary), never decoded
unless an operator needs code points.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import weakref

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are worked on in slices of about this many bytes, which bounds a Python worker's memory.
SLICE_BYTES = 4 << 20


def utf8(col: str) -> Column:
    """The column as UTF-8 bytes; NULL is the empty text."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("")).cast("binary")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="polystrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_STAGED: list[str] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables now; only for those from which nothing is read any more, however late."""
    for table in tables:
        path = _PATHS.pop(table)
        _delete(table.sparkSession, path)
        _STAGED.remove(path)


def release(spark: SparkSession) -> int:
    """Delete the tables staged so far by this driver; results that read them must be written before. Their number is returned."""
    for path in _STAGED:
        _delete(spark, path)
    n = len(_STAGED)
    _STAGED.clear()
    return n


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array without NULLs, as NumPy views."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of about ``limit`` bytes each; a longer text is a range of its own."""
    n, start = len(offsets) - 1, 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


def binary_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary array over ``values`` (any dtype); offsets count items."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mul)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _trim() -> Callable[[int], int]:
    """The C library's call that hands freed memory back to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Return the unused memory of Arrow and of NumPy to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow`` that gives unused memory back after each batch and at its end.

    Workers are used again by later tasks; without this each keeps the most that any of them took.
    """

    def tidied(batches: Iterator) -> Iterator:
        def each():
            for batch in batches:
                yield batch
                del batch
                give_back()

        try:
            yield from run(each())
        finally:
            give_back()

    return tidied


#: Bytes of input that one bucket of packed rows stands for.
BUCKET_BYTES = 32 << 20


def buckets(df: DataFrame) -> int:
    """Buckets for packed rows of ``df``: they grow with the input, so that a bucket's size does not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 55)  # sources that cannot tell say a huge number
    return max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // BUCKET_BYTES))


def free_names(df: DataFrame, *names: str) -> None:
    """Raise if a column that is about to be added is there already (names compare without case, as Spark's do)."""
    taken = {c.lower() for c in df.columns}
    clash = [n for n in names if n.lower() in taken]
    if clash:
        raise ValueError(f"column {', '.join(clash)} is there already; rename it before")


def arrow_column(work: Callable[[], Callable[[pa.Array], pa.Array]], kind: T.DataType, limit: int = SLICE_BYTES) -> Callable[[Column], Column]:
    """A function of one column, binary or of lists, that crosses to Python alone; the row's other columns stay in the JVM.

    ``work()`` runs once per task and gives a function from a slice of about
    ``limit`` bytes (or list items) to an array of as many results.  The column is
    marked as not deterministic so that plans never compute it twice.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        do = work()
        try:
            for column in batches:
                if not len(column):
                    yield do(column)
                    continue
                sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))])
                for start, stop in slices(ends, limit):
                    yield do(column.slice(start, stop - start))
                del column
                give_back()
        finally:
            del do
            give_back()

    return F.arrow_udf(run, kind).asNondeterministic()
