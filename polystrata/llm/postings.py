"""Inverted postings: terms of documents, packed by (block, bucket of terms), and sums back per document.

A block is a slice of an input partition (at most 65,536 documents and about
12 MB of text); a bucket is a share of all terms by hash.  One packed row holds
the block's terms of one bucket with the documents that have them, so each
distinct term of the corpus is met in exactly one bucket, and a term has at most
one entry per block however common it is: a word of every document is no hot
key.  A task that gets a bucket finds its distinct terms, values each once, and
sends every block one number per document; blocks add these up.

Only packed rows are shuffled (about a third of the text's size).  Block numbers
follow from the input's partitions and order, so the input should be a table or
another source that is read again in the same order.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK_BYTES, BLOCK_DOCS = 12 << 20, 1 << 16

_PACKED = "bucket int, block long, n_terms int, sizes binary, terms binary, counts binary, posts binary, freqs binary, weights binary, info binary, tokens long, docs long"
_SUMS = "block long, sums binary, info binary, tokens long, docs long"


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each number) of numbers below 2**35, seven bits to a byte, the low ones first."""
    most = int(values.max()) if len(values) else 0
    size, parts = np.ones(len(values), np.int64), np.empty((len(values), 1 + sum(most >= 1 << 7 * k for k in range(1, 5))), np.uint8)
    has = np.ones(parts.shape, bool)
    for k in range(parts.shape[1]):
        rest = values >> 7 * k
        more = rest >= 128
        parts[:, k] = (rest & 127) | more.astype(np.uint8) << 7
        if k + 1 < parts.shape[1]:
            has[:, k + 1] = more
            size += more
    return parts[has], np.cumsum(size)


def _numbers(raw: bytes) -> np.ndarray:
    """The numbers that :func:`_varints` packed."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    start = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1])
    shift = np.arange(len(data)) - np.repeat(start, np.diff(np.concatenate([start, [len(data)]])))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * shift, start)


#: A random number for each (place in a term modulo 64, byte): a term's hash is the sum over its bytes.
_LETTERS = common.mix64(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Bytes of terms that are hashed at once; a longer term is hashed in another way.
_RUN = 1 << 18


def _buckets(terms: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of each term, which follows from its bytes alone."""
    raw, ends = common.byte_rows(terms)
    out = np.zeros(len(terms), np.uint64)
    for low, high in common.slices(ends, _RUN):
        own, at = raw[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        if len(own) > _RUN:
            out[low] = zlib.crc32(own)
            continue
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_LETTERS.take((np.arange(len(own)) - np.repeat(at[:-1], np.diff(at)) & 63) << 8 | own), out=total[1:])
        out[low:high] = common.mix64(total.take(at[1:]) - total.take(at[:-1]))
    return (out % np.uint64(buckets)).astype(np.int64)


def _pack(codes: np.ndarray, docs: np.ndarray, terms: pa.Array, weights: np.ndarray, buckets: int):
    """(bucket, columns of a packed row) for each bucket that has terms, from a (term, document) pair per occurrence."""
    if not len(terms):
        return
    bucket = _buckets(terms, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, (raw, ends) = bucket[order], common.byte_rows(terms.take(pa.array(order)))
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    keys = np.sort(rank[codes] << 16 | docs)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    freq = np.diff(np.concatenate([first, [len(keys)]]))
    term, doc = keys[first] >> 16, keys[first] & 0xFFFF
    weight = np.bincount(term, freq * weights[doc], len(terms)).astype(np.int64)
    step, heads, more = np.diff(doc, prepend=0), np.concatenate([[True], term[1:] != term[:-1]]), freq > 1
    step[heads] = doc[heads]
    posts, post_ends = _varints(step * 2 + more)
    freqs, freq_ends = _varints(freq[more])
    bounds = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(terms)]])
    at = np.concatenate([[0], post_ends])[np.searchsorted(term, bounds)]
    fat = np.concatenate([[0], freq_ends])[np.searchsorted(term[more], bounds)]
    count = np.bincount(term, minlength=len(terms))
    for k in range(len(bounds) - 1):
        low, high = bounds[k], bounds[k + 1]
        yield int(bucket[low]), (int(high - low), _varints(np.diff(ends[low : high + 1]))[0].tobytes(), raw[ends[low] : ends[high]].tobytes(), _varints(count[low:high])[0].tobytes(), posts[at[k] : at[k + 1]].tobytes(), freqs[fat[k] : fat[k + 1]].tobytes(), _varints(weight[low:high])[0].tobytes())


def _info_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), T.StructField("n_terms", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("doc_weight", T.IntegerType()), T.StructField("measure", T.DoubleType())])


def _each(terms_of: Callable[[bytes], list]) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, pa.Array]]:
    """A function of a block's texts, from one of a text."""

    def terms(texts):
        memo: dict = defaultdict(itertools.count().__next__)
        code, parts, sizes = memo.__getitem__, [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = np.fromiter(map(code, terms_of(text)), np.int32)
            parts.append(found)
            sizes[k] = len(found)
        return np.concatenate(parts), sizes, pa.array([t.encode() if isinstance(t, str) else t for t in memo], pa.binary())

    return terms


def build(df: DataFrame, id_col: str, text_col: str, split: Callable[[], Callable], whole: bool = False, weight: Column | None = None, measure: Callable[[list[bytes]], np.ndarray] | None = None) -> DataFrame:
    """Packed rows of ``df``.

    ``split()`` runs once per task and gives a function from a text's bytes to
    its terms (bytes or str), or with ``whole`` from a block's texts to (number of
    each term among the distinct ones, terms of each text, distinct terms).  ``weight``: 0 or 1 by document; a term's weight is its frequency over
    documents of weight 1.  ``measure`` gives a number for each of a list of
    texts, kept with the documents.
    """
    info = _info_schema(df.schema[id_col].dataType)
    weight = F.lit(1) if weight is None else weight
    rows = df.select(F.col(f"`{id_col}`").alias("id"), common.utf8(text_col).alias("text"), weight.cast("int").alias("doc_weight"))
    buckets = common.buckets(rows)
    names = [x.split()[0] for x in _PACKED.split(", ")]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, terms_of = to_arrow_schema(info), split() if whole else _each(split())
        types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7, pa.int64(), pa.int64()]
        task, serial = TaskContext.get().partitionId(), itertools.count()

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            texts, ids, weights = batch.column(1), batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            _, ends = common.byte_rows(texts)
            for start, stop in common.slices(ends, BLOCK_BYTES):
                for at in range(start, stop, BLOCK_DOCS):
                    n = min(BLOCK_DOCS, stop - at)
                    block = task << 32 | next(serial)
                    own = texts.slice(at, n).to_pylist()
                    measures = pa.nulls(n, pa.float64()) if measure is None else pa.array(measure(own))  # before the block's terms are held
                    codes, sizes, terms = terms_of(own)
                    for bucket, columns in _pack(codes, np.repeat(np.arange(n), sizes), terms, weights[at : at + n], buckets):
                        yield row(bucket, block, *columns, None, None, None)
                    held = pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(sizes), pa.array(np.diff(ends[at : at + n + 1])), pa.array(weights[at : at + n].astype(np.int32)), measures], schema=arrow)
                    kept = weights[at : at + n] == 1
                    yield row(block % buckets, block, 0, *[None] * 6, held.serialize().to_pybytes(), int(sizes[kept].sum()), int(kept.sum()))

    return rows.mapInArrow(common.tidy(run), _PACKED)


def value_terms(packed: DataFrame, value: Callable[[], Callable[[list[bytes], np.ndarray], np.ndarray]], n_values: int, tally: bool = False) -> DataFrame:
    """(block, sums, info, ...): for each block and bucket a number per document and value, sums of frequency times value.

    ``value()`` runs once per task and gives a function from (distinct terms,
    their weights) to an array (terms, ``n_values``).  ``tally`` adds a row with
    block -1 per bucket, whose ``tokens`` is its number of terms of positive weight.
    """
    names = [x.split()[0] for x in _SUMS.split(", ")]

    def row(block, sums, info, tokens, docs):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sums], pa.binary()), pa.array([info], pa.binary()), pa.array([tokens], pa.int64()), pa.array([docs], pa.int64())], names=names)

    def one_bucket(held, worth):
        sizes = [_numbers(r["sizes"]) for r in held]
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        coded = common.binary_array(np.frombuffer(b"".join(r["terms"] for r in held), np.uint8), ends).dictionary_encode()
        codes = coded.indices.to_numpy()
        weights = np.bincount(codes, np.concatenate([_numbers(r["weights"]) for r in held]), len(coded.dictionary)).astype(np.int64)
        values = worth(coded.dictionary.to_pylist(), weights)
        low = 0
        for r, size in zip(held, sizes, strict=True):
            count, steps = _numbers(r["counts"]), _numbers(r["posts"])
            docs, more = np.cumsum(steps >> 1), (steps & 1).astype(bool)
            heads = np.cumsum(count) - count
            docs -= np.repeat(docs[heads] - (steps[heads] >> 1), count)
            freq = np.ones(len(docs))
            freq[more] = _numbers(r["freqs"])
            mine = np.repeat(values[codes[low : low + len(size)]], count, 0)
            sums = np.stack([np.bincount(docs, freq * mine[:, k]) for k in range(n_values)], 1)
            yield row(r["block"], sums.tobytes(), None, None, None)
            low += len(size)
        if tally:
            yield row(-1, None, None, int((weights > 0).sum()), None)

    def run(batches):
        worth, at, held = value(), None, []
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["info"] is not None:
                    yield row(r["block"], None, r["info"], r["tokens"], r["docs"])
                    continue
                if r["bucket"] != at and held:
                    yield from one_bucket(held, worth)
                    held = []
                at = r["bucket"]
                held.append(r)
        if held:
            yield from one_bucket(held, worth)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(common.tidy(run), _SUMS)


def sum_blocks(sums: DataFrame, id_type: T.DataType, values: list[str]) -> DataFrame:
    """(id, n_terms, n_bytes, doc_weight, measure, *values): a row per document, its sums over all buckets."""
    info = _info_schema(id_type)
    schema = T.StructType([*info.fields, *[T.StructField(v, T.DoubleType()) for v in values]])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, out, at, held, total = to_arrow_schema(info), to_arrow_schema(schema), None, None, np.zeros((0, len(values)))

        def done():
            whole = np.zeros((held.num_rows, len(values)))
            whole[: len(total)] = total
            return pa.RecordBatch.from_arrays([*held.columns, *[pa.array(np.ascontiguousarray(whole[:, k])) for k in range(len(values))]], schema=out)

        for batch in batches:
            for block, sums, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if block != at and held is not None:
                    yield done()
                    held, total = None, np.zeros((0, len(values)))
                at = block
                if own.is_valid:
                    held = pa.ipc.read_record_batch(own.as_buffer(), arrow)
                else:
                    more = np.frombuffer(sums.as_buffer()).reshape(-1, len(values))
                    if len(more) > len(total):
                        total, more = more.copy(), total
                    total[: len(more)] += more
        if held is not None:
            yield done()

    return sums.where("block >= 0").select("block", "sums", "info").repartition("block").sortWithinPartitions("block").mapInArrow(common.tidy(run), schema)
