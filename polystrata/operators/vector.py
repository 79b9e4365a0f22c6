"""Vector operators: rows with similarities and distances, k nearest neighbours, joins."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import VectorError
from ..functions import kernels as K
from ..plans.lower import literal

MOST_K, MOST_THREADS = 10_000, 64
BY_SIMILARITY = {"cosine", "dot", "jaccard"}
#: Rows of a block of the similarity join.
BLOCK = 8192
#: Norms whose squares and products neither vanish nor overflow; the join's cell for others.
TINY, HUGE, _WILD = 1e-140, 1e150, -9


def vector_column(df: DataFrame) -> str:
    """The column that vectors are looked for in: embedding, then vector."""
    for name in ("embedding", "vector"):
        if name in df.columns:
            return name
    raise VectorError("no column embedding or vector")


def _pair(df: DataFrame, a: str, b: str) -> tuple[Column, Column]:
    return F.col(f"`{a}`"), F.col(f"`{b}`")


def cosine_similarity(df: DataFrame, a: str = "vector1", b: str = "vector2") -> DataFrame:
    return df.withColumn("similarity", K.cosine(*_pair(df, a, b)))


def euclidean_distance(df: DataFrame, a: str = "vector1", b: str = "vector2") -> DataFrame:
    return df.withColumn("distance", K.euclidean(*_pair(df, a, b)))


def dot_product(df: DataFrame, a: str = "vector1", b: str = "vector2") -> DataFrame:
    return df.withColumn("dot_product", K.dot(*_pair(df, a, b)))


def normalize(df: DataFrame, column: str | None = None) -> DataFrame:
    return df.withColumn("normalized_vector", K.normalize(F.col(f"`{column or vector_column(df)}`")))


def knn(df: DataFrame, query: list[float] | Column, k: int, column: str | None = None, metric: str = "euclidean", tie: str | None = None) -> DataFrame:
    """The k nearest rows with ``distance`` (or ``similarity`` for metrics of similarity), nearest first; rows without a vector are skipped."""
    if not 1 <= k <= MOST_K:
        raise VectorError(f"k lies between 1 and {MOST_K}")
    v, q = F.col(f"`{column or vector_column(df)}`"), literal(query)
    rows = df.where(v.isNotNull())
    ties = [F.col(f"`{tie}`")] if tie else []
    if metric in BY_SIMILARITY:
        return rows.withColumn("similarity", K.similarity(v, q, metric)).orderBy(F.desc("similarity"), *ties).limit(k)
    return rows.withColumn("distance", K.distance(v, q, metric)).orderBy("distance", *ties).limit(k)


def similarity_search(df: DataFrame, query: list[float] | Column, threshold: float | None = None, column: str | None = None) -> DataFrame:
    """Rows of cosine at least ``threshold`` with ``similarity``, most similar first."""
    if threshold is not None and not -1 <= threshold <= 1:
        raise VectorError("a cosine threshold lies between -1 and 1")
    v = F.col(f"`{column or vector_column(df)}`")
    out = df.where(v.isNotNull()).withColumn("similarity", K.cosine(v, literal(query)))
    return (out if threshold is None else out.where(F.col("similarity") >= threshold)).orderBy(F.desc("similarity"))


def diverse(df: DataFrame, category: str, per_category: int, by: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    """At most ``per_category`` rows of each category, the best by ``by``: the category diversity constraint."""
    order = [F.desc(by) if descending else F.asc(by), *([F.asc(tie)] if tie else [])]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("_rank") <= per_category).drop("_rank")


def spread(df: DataFrame, column: str, min_distance: float, k: int, by: str, tie: str | None = None, spatial: bool = False) -> DataFrame:
    """Diversity by feature (euclidean) or position (``spatial``: hyperbolic): greedily the best row at least ``min_distance`` from all chosen before, at most k.

    Each step is one distributed minimum over all rows left; only the k chosen vectors come to the driver.
    """
    if min_distance <= 0:
        raise VectorError("min_distance is over 0")
    if not 1 <= k <= MOST_K:
        raise VectorError(f"k lies between 1 and {MOST_K}")
    out, left = None, df.where(F.col(f"`{column}`").isNotNull() & F.col(f"`{by}`").isNotNull())
    for _ in range(k):
        best = left.orderBy(by, *([tie] if tie else []), F.col(f"`{column}`").cast("string")).limit(1)
        found = best.collect()
        if not found:
            break
        at = found[0][column]
        one = df.sparkSession.createDataFrame(found, df.schema)
        out = one if out is None else out.unionByName(one)
        if spatial:
            apart = K.hyperbolic(F.col(f"`{column}`"), K.position(*[F.lit(float(at[c])) for c in "xyz"]))
        else:
            apart = K.euclidean(F.col(f"`{column}`"), literal([float(x) for x in at]))
        left = left.where(apart >= F.lit(float(min_distance)))
    return df.limit(0) if out is None else out


def _solver(threshold: float):
    """For ``mapInArrow``: pairs of each left block with the right rows of its key; rows come sorted by key, left ones first.

    Matrix products in single precision pick candidates with room for their rounding;
    these are computed again as :func:`kernels.cosine` does, term by term.
    """

    def block(ids, vectors):
        n = len(ids)
        m = np.asfortranarray(vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1), np.float64)
        size = np.sqrt(sum(m[:, d] * m[:, d] for d in range(m.shape[1])))
        unit = (m / size[:, None]).astype(np.float32)
        unit[~((size > TINY) & (size < HUGE))] = np.nan  # candidates with every row
        return ids, m, size, unit

    def exact(left, right, at, width, low):
        i, j = at // width, at % width + low
        total = np.zeros(len(at))
        for d in range(left[1].shape[1]):
            total += left[1][:, d][i] * right[1][:, d][j]
        sizes = left[2][i] * right[2][j]
        if not sizes.all():
            raise VectorError("a zero vector has no cosine")
        total /= sizes
        keep = ~(total < threshold)  # Spark's order has NaN above all numbers
        return pa.RecordBatch.from_arrays([left[0].take(pa.array(i[keep])), right[0].take(pa.array(j[keep])), pa.array(total[keep])], names=["left_id", "right_id", "similarity"])

    def pairs(left, right):
        bound = np.float32(threshold - 2e-7 * (left[1].shape[1] + 8))
        for low in range(0, len(right[0]), 1024):
            near = left[3] @ right[3][low : low + 1024].T
            found = np.flatnonzero(~(near < bound))
            for k in range(0, len(found), 1 << 17):
                yield exact(left, right, found[k : k + (1 << 17)], near.shape[1], low)

    def run(batches):
        at, held, left = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(5)])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for low, high in itertools.pairwise([0, *ends.tolist(), batch.num_rows] if batch.num_rows else []):
                key, part = tuple(keys[:4, low]), batch.slice(low, high - low)
                if key != at:
                    at, held, left = key, [], None
                with np.errstate(all="ignore"):
                    if keys[4, low] == 0:
                        held.append(part)
                    elif held:
                        if left is None:
                            rows = pa.Table.from_batches(held).combine_chunks()
                            left = block(*(rows.column(c).combine_chunks() for c in ("left_id", "v")))
                        yield from pairs(left, block(part.column("right_id"), part.column("v")))

    return run


def similarity_join(a: DataFrame, b: DataFrame, on: tuple[str, str], threshold: float, pivot: list[float], names: tuple[str, str]) -> DataFrame:
    """Pairs of cosine at least ``threshold``, exactly and without a cross join.

    The angle is a metric: vectors within angle t of each other have angles to
    the pivot that differ by at most t.  Rows are put in cells of width t of that
    angle, and only the same and neighbouring cells meet.  Cells are cut by hash into
    blocks of about :data:`BLOCK` rows, and pairs of blocks are matrix products.  In many
    dimensions angles to a pivot crowd around a right angle and few cells hold most
    rows, so the join compares fewer pairs only if the threshold is close to 1; the
    rows sent are then (rows / BLOCK) times both sides.  NULL vectors and those with NULL
    elements have no pairs; vectors whose cosine may not be a number meet all rows.
    """
    # a cosine is known to about 1e-15, an angle near 0 thus to about 1e-7
    width = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    floats = all(df.schema[c].dataType == T.ArrayType(T.FloatType(), df.schema[c].dataType.containsNull) for df, c in zip((a, b), on, strict=True))
    kinds = [df.schema[c].dataType for df, c in zip((a, b), names, strict=True)]

    def side(df: DataFrame, name: str, column: str) -> DataFrame:
        v = F.col("v")
        rows = df.select(F.col(name).alias("id"), F.col(column).cast("array<float>" if floats else "array<double>").alias("v"))
        rows = rows.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull()))
        to, size = K.cosine(v, literal(pivot)), K.norm(v)
        cell = F.floor(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), to))) / width)
        plain = (size > TINY) & (size < HUGE) & ~F.isnan(to)
        return rows.select("id", "v", F.when(plain, cell).otherwise(_WILD).alias("cell"), F.xxhash64("id", "v").alias("h"))

    def blocks(rows: DataFrame, cell: str, n: str) -> DataFrame:
        return rows.groupBy(F.col("cell").alias(cell)).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))

    left, right = side(a, names[0], on[0]), side(b, names[1], on[1])
    ours, theirs = blocks(left, "lc", "nl"), blocks(right, "rc", "nr")
    near = theirs.where(F.col("rc") != _WILD).withColumn("lc", F.explode(F.array(F.col("rc") - 1, F.col("rc"), F.col("rc") + 1)))
    met = ours.join(near, "lc").select("lc", "nl", "rc", "nr")
    met = met.unionByName(ours.where(F.col("lc") == _WILD).crossJoin(theirs)).unionByName(ours.where(F.col("lc") != _WILD).crossJoin(theirs.where(F.col("rc") == _WILD)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod("h", F.col(n)).cast("int")
    none = [F.lit(None).cast(kind) for kind in kinds]
    left = left.join(met, left["cell"] == met["lc"]).select("lc", "rc", own("nl").alias("i"), numbers("nr").alias("j"), F.lit(0).alias("side"), F.col("id").alias("left_id"), none[1].alias("right_id"), "v")
    right = right.join(met, right["cell"] == met["rc"]).select("lc", "rc", numbers("nl").alias("i"), own("nr").alias("j"), F.lit(1).alias("side"), none[0].alias("left_id"), F.col("id").alias("right_id"), "v")
    key = ["lc", "rc", "i", "j"]
    out = T.StructType([T.StructField("left_id", kinds[0]), T.StructField("right_id", kinds[1]), T.StructField("similarity", T.DoubleType())])
    return left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(_solver(threshold), out)


def approximate_knn(df: DataFrame, query: list[float], k: int, column: str, bucket_length: float = 2.0, tables: int = 4) -> DataFrame:
    """k nearest by euclidean distance with random-projection buckets: fast, and some neighbours may be missed."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    model = BucketedRandomProjectionLSH(inputCol="_features", outputCol="_hashes", bucketLength=bucket_length, numHashTables=tables, seed=7)
    rows = df.withColumn("_features", array_to_vector(F.col(column).cast("array<double>")))
    return model.fit(rows).approxNearestNeighbors(rows, Vectors.dense(query), k, distCol="distance").drop("_features", "_hashes")


def check_compatible(metric: str, kind: str) -> None:
    """Metrics that a kind of vector (dense, sparse, colbert) does not take."""
    if (metric, kind) in {("jaccard", "dense"), ("cosine", "colbert")}:
        raise VectorError(f"{metric} does not apply to {kind} vectors")


def check_knn(k: int, factor: float | None = None, threads: int | None = None) -> None:
    """Bounds of a k-NN query."""
    if not 1 <= k <= MOST_K:
        raise VectorError(f"k lies between 1 and {MOST_K}")
    if factor is not None and not 0 <= factor <= 1:
        raise VectorError("the approximation factor lies between 0 and 1")
    if threads is not None and not 1 <= threads <= MOST_THREADS:
        raise VectorError(f"threads lie between 1 and {MOST_THREADS}")


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps from dimension to value."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    dot = F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.element_at(b, k))
    size = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    return dot / (size(a) * size(b))


def late_interaction(query: Column, document: Column) -> Column:
    """Multi-vector score: for each query vector the best dot product, summed."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: K.dot(q, d)))), F.lit(0.0), lambda s, x: s + x)
