"""Near-duplicates by bottom-k sketches of one hash function, verified by exact Jaccard.

1. A document's set is its distinct five-word shingles (A-Z lower-cased); equal
   sets become one node.  A node's sketch is its 64 smallest shingle hashes.
2. Inverted lists of retained values give overlaps.  Values are ordered by how
   many nodes retain them; two sets of Jaccard 0.75 share so many retained values
   that their rarest shared one lies among the first 40 of both, so only these are
   listed, and boilerplate makes no lists.  This is certain if one of the two has
   fewer than 64 shingles: its partner has 84 at most, so 43 of the shared values
   are retained.  Else the chance of a miss is about 2e-9.  Sets of fewer than 48 have
   partners that retain all their values, and list n - ceil(0.75 n) + 1.
3. Lists of up to 16 nodes give their pairs.  A longer list gives the pairs of one
   pivot with its other nodes (lists of one family choose the same pivot), and verified
   links become components.  A list whose nodes are then all in one component is done:
   a family of m near copies costs about m pairs.  Nodes of lists that stay open are
   held against their full sets: with g of n shingles that others of them have as
   well, a node with g / n under 0.75 has no partner (texts that merely share a
   passage) and leaves.  The rest form families by common lists.  In each the nodes
   outside the largest component, the strays, are compared with all others of like
   size: both are cut by hash into blocks of about 512 nodes, and pairs of blocks
   with a stray one are solved exactly as matrix products, which hand on a spanning
   forest of their links.  Nodes of the largest component are not compared with each
   other, so s strays among m nodes cost s m / 512**2 products.
4. The union of two sketches estimates Jaccard; pairs under 0.45 (5.5 standard
   deviations below 0.75) go.
5. What is left of them is verified on the full sets: 100 * |A & B| >= 75 * |A | B|.
   A pivot's sketch and set are copied by the length of its list, so no task gets all
   partners of one pivot.

Defined results: NULL, empty and wordless texts have an empty set and are linked
with nothing; a text of fewer than five words is one shingle; repeated rows share
a node; NULL ids take part but are nobody's ``component_id``; an empty table gives
an empty table.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

SHINGLE, KEEP, PREFIX, SMALL_LIST, BLOCK = 5, 64, 40, 16, 512
#: Nodes that meet one copy of a pivot.
SPREAD = 2_000
PERCENT, ESTIMATE = 75, 0.45
_BUCKETS = 1 << 20
#: Bytes of text cut into shingles at once.
_CUT = 1 << 20

_STEPS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    memo: dict = defaultdict(itertools.count().__next__)
    code, codes, sizes = memo.__getitem__, [], []
    for text in texts:
        found = np.fromiter(map(code, text.lower().split()), np.int64)
        codes.append(found)
        sizes.append(len(found))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, memo), np.uint64, len(memo))
    out = []
    for found, n in zip(codes, sizes, strict=True):
        h = hashes[found]
        if n >= SHINGLE:
            sums = sum(h[k : n - SHINGLE + 1 + k] * _STEPS[k] for k in range(SHINGLE))
        elif n:  # one shorter shingle; its length keeps it apart
            sums = (h * _STEPS[:n]).sum(keepdims=True) + np.uint64(n)
        else:
            sums = h
        mixed = np.sort(common.mix64(sums))
        out.append(mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])] if len(mixed) else mixed)
    return out


def _signature(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def text_key(col: str) -> Column:
    """A 64-bit hash of the text, which tells rows of one id apart."""
    return F.xxhash64(common.utf8(col))


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, sig, sketch): hash of the text, size and 128-bit signature of the set, and its smallest hashes, ascending."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType(), False))])

    def run(batches):
        for batch in batches:
            _, ends = common.byte_rows(batch.column(2))
            for start, stop in common.slices(ends, _CUT):
                sets = shingle_sets(batch.column(2).slice(start, stop - start).to_pylist())
                kept = [s[:KEEP].view(np.int64) for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]), pa.int32()), pa.array(np.concatenate(kept)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, stop - start) for c in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.binary()), lists], names=schema.names)

    return df.select(F.col(f"`{id_col}`").alias("id"), text_key(text_col).alias("key"), common.utf8(text_col).alias("text")).mapInArrow(common.tidy(run), schema)


def _id_bucket(col: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(_BUCKETS)).alias("_ps_bucket")


def full_sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes ``wanted`` (node, sig, min_id); one row a node.

    Texts are sieved by a hash of the id (at most 2**20 numbers, broadcast) before
    they are cut into shingles again.
    """
    sieve = wanted.select(_id_bucket("min_id")).distinct()
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("_ps_bucket", _id_bucket("id"))
    texts = texts.join(F.broadcast(sieve), "_ps_bucket", "left_semi").select(common.utf8("text").alias("text"))

    def run(batches):
        for batch in batches:
            _, ends = common.byte_rows(batch.column(0))
            for start, stop in common.slices(ends, _CUT):
                sets = shingle_sets(batch.column(0).slice(start, stop - start).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_signature(s) for s in sets], pa.binary()), lists], names=["sig", "hashes"])

    found = texts.mapInArrow(common.tidy(run), "sig binary, hashes array<long>").where("sig IS NOT NULL")
    return found.join(wanted.select("sig", "node"), "sig").drop("sig").dropDuplicates(["node"]).select("node", "hashes")


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """(value, node, n, m): for each node its listed values that other nodes list too; m is the list's length."""
    flat = nodes.select("node", F.explode("sketch").alias("value"))
    shared = flat.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # values that one node alone retains come first in its order; the rest are ranked by df
    held = flat.join(shared, "value").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("held"))
    held = held.join(nodes.select("node", "n", F.size("sketch").alias("k")), "node")
    # from 48 shingles on a partner may have cut off values, which then look as if this node alone had them
    prefix = F.when(F.col("n") * 100 >= KEEP * PERCENT, PREFIX).otherwise(F.col("n") - F.ceil(F.col("n") * (PERCENT / 100)) + 1)
    take = prefix - (F.col("k") - F.size("held"))
    listed = held.where(take > 0).select("node", "n", F.explode(F.slice("held", F.lit(1), take.cast("int"))).alias("h")).select("h.value", "node", "n")
    listed = common.stage_table(listed, "lists")
    sizes = common.stage_table(listed.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    lists = common.stage_table(listed.join(sizes, "value"), "lists")
    common.discard(listed, sizes)
    return lists


def _alike_sizes(a: str, b: str) -> Column:
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def small_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b, m), a < b, within lists of at most :data:`SMALL_LIST` nodes."""
    groups = lists.where(F.col("m") <= SMALL_LIST).groupBy("value").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("g"))
    pairs = groups.select(F.posexplode("g").alias("p", "x"), "g").select("x", F.explode(F.slice("g", F.col("p") + 2, F.lit(SMALL_LIST))).alias("y"))
    return pairs.where(_alike_sizes("x.n", "y.n")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().withColumn("m", F.lit(1).cast("long"))


def _rank(col: str) -> Column:
    """A number in [0, 2**32) that orders nodes the same way in every list, so that lists of one family choose the same pivots."""
    return F.pmod(F.xxhash64(F.col(col), F.lit(17)), F.lit(1 << 32))


def first_pairs(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, m) of the one pivot of each longer list with its other nodes, and the lists (value, node, n) without their pivots."""
    long = lists.where(F.col("m") > SMALL_LIST)
    chosen = common.stage_table(long.groupBy("value").agg(F.min(F.struct(_rank("node").alias("r"), "node", "n")).alias("p")).select("value", F.col("p.node").alias("a"), F.col("p.n").alias("na")), "pivots")
    met = long.join(chosen, "value").where("a <> node")
    pairs = met.where(_alike_sizes("na", "n")).groupBy("a", F.col("node").alias("b")).agg(F.max("m").alias("m"))
    return pairs, met.select("value", "node", "n")


def _attached(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b, m) with ``column`` of both ends as ``ha`` and ``hb``; a node ``a`` of many pairs is copied instead of gathering them."""
    share = F.greatest(F.lit(1), F.ceil(F.col("m") / SPREAD)).cast("int")
    copies = pairs.groupBy("a").agg(F.max(share).alias("copies"))
    mine = held.select(F.col("node").alias("a"), F.col(column).alias("ha")).join(copies, "a").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    other = pairs.withColumn("share", F.pmod(F.xxhash64("b"), share).cast("int")).join(held.select(F.col("node").alias("b"), F.col(column).alias("hb")), "b")
    return other.join(mine, ["a", "share"])


def _passes(a: str, b: str) -> Column:
    """Whether the union sketch of two sketches lets Jaccard reach the threshold."""
    # values are stored as signed longs; their order as unsigned ones is that of the hash
    flip = lambda x: F.transform(x, lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))
    union = F.slice(F.array_sort(flip(F.array_union(a, b))), 1, KEEP)
    return F.size(F.array_intersect(union, flip(F.array_intersect(a, b)))) >= F.lit(ESTIMATE) * F.size(union)


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b, m) whose union sketch lets Jaccard reach the threshold."""
    return _attached(pairs, nodes, "sketch").where(_passes("ha", "hb")).select("a", "b", "m")


def sets_of(wanted: DataFrame, df: DataFrame, id_col: str, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes ``wanted`` (node)."""
    wanted = common.stage_table(wanted.distinct().join(nodes.select("node", "sig", "min_id"), "node"), "wanted")
    sets = common.stage_table(full_sets(df, id_col, text_col, wanted), "sets")
    common.discard(wanted)
    return sets


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets."""
    shared = F.size(F.array_intersect("ha", "hb"))
    return _attached(pairs, sets, "hashes").where(shared * 100 >= (F.size("ha") + F.size("hb") - shared) * PERCENT).select("a", "b")


def _able(sets: DataFrame) -> DataFrame:
    """(node) of the sets that share at least 75 % of their shingles with others of them."""
    flat = sets.select("node", F.explode("hashes").alias("x"))
    shared = flat.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("x")
    counts = flat.join(shared, "x").groupBy("node").agg(F.count(F.lit(1)).alias("g"))
    return sets.select("node", F.size("hashes").alias("n")).join(counts, "node").where(F.col("g") * 100 >= F.col("n") * PERCENT).select("node")


def open_lists(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (value, node, n, comp) of the lists whose nodes are in several components."""
    held = rows.join(comps, "node", "left").select("value", "node", "n", F.coalesce("comp", "node").alias("comp"))
    several = held.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("value")
    return common.stage_table(held.join(common.stage_table(several, "several"), "value"), "open")


def _families(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(fam, node, n, stray, hashes) of the nodes of open lists; lists with common nodes are one family."""
    heads = common.stage_table(rows.groupBy("value").agg(F.min("node").alias("head")), "heads")
    fams = graph.components(rows.join(heads, "value").select(F.col("node").alias("a"), F.col("head").alias("b")))
    nodes = common.stage_table(rows.select("node", "n", "comp").distinct().join(fams.select(F.col("node").alias("node"), F.col("comp").alias("fam")), "node"), "families")
    parts = nodes.groupBy("fam", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = common.stage_table(parts.groupBy("fam").agg(F.max(F.struct("c", "comp")).alias("top")).select("fam", F.col("top.comp").alias("main")), "main")
    return nodes.join(main, "fam").withColumn("stray", F.col("comp") != F.col("main")).drop("comp", "main").join(sets, "node")


def _forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of hashes."""
    n = np.array([len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    names = np.cumsum(count > 1) - 1
    use = count[code] > 1
    rows, cols = np.repeat(np.arange(len(sets)), n)[use], names[code[use]]
    common_n = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for low in range(0, int(names[-1]) + 1, 2048):
        cut = slice(*np.searchsorted(cols, (low, low + 2048)))
        m = np.zeros((len(sets), 2048), np.float32)
        m[rows[cut], cols[cut] - low] = 1
        common_n += m @ m.T
    linked = common_n * 100 >= (n[:, None] + n[None, :] - common_n) * PERCENT
    seen, out = np.zeros(len(sets), bool), []
    for root in range(len(sets)):
        front = [] if seen[root] else [root]
        seen[root] = True
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            out += [(at, int(x)) for x in new]
            front += new.tolist()
    return out


def block_links(families: DataFrame) -> DataFrame:
    """Links (a, b) that connect the strays of each family with what they are linked with."""
    # sets of Jaccard 0.75 are in the same or in adjacent bands of size
    rows = families.withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int"))
    blocks = rows.groupBy("fam", "band", "stray").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    # at most two kinds of about forty bands
    cells = common.stage_table(blocks.groupBy("fam").agg(F.collect_list(F.struct("band", "stray", "nb")).alias("cells")), "cells")
    rows = rows.join(cells, "fam")
    mine = F.element_at(F.filter("cells", lambda c: (c["band"] == F.col("band")) & (c["stray"] == F.col("stray"))), 1)["nb"]
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), mine).cast("int"))
    here = F.struct("band", "stray", "block")
    near = F.filter("cells", lambda c: (F.abs(c["band"] - F.col("band")) <= 1) & (c["stray"] | F.col("stray")))
    there = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["nb"] - 1), lambda j: F.struct(c["band"].alias("band"), c["stray"].alias("stray"), j.alias("block")))))
    dealt = rows.select("fam", "node", "hashes", here.alias("here"), F.explode(there).alias("there"))
    dealt = dealt.select(F.xxhash64("fam", F.least("here", "there"), F.greatest("here", "there")).alias("key"), "fam", "node", "hashes")

    def solve(batches):
        def done(table):
            names, sets = table.column("node").to_pylist(), [np.array(h, np.int64) for h in table.column("hashes").to_pylist()]
            edges = _forest(sets)
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in edges], pa.int64()), pa.array([names[y] for _, y in edges], pa.int64())], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = table.column("key").to_numpy()
            bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
            for low, high in itertools.pairwise(bounds):
                yield done(table.slice(low, high - low))
            held = table.slice(bounds[-1])
        if held is not None:
            yield done(held)

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(common.tidy(solve), "a long, b long")


def links(df: DataFrame, id_col: str, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, comp) of all nodes that are linked with another."""
    lists = inverted_lists(nodes)
    pairs, rows = first_pairs(lists)
    likely = common.stage_table(estimated(small_pairs(lists).unionByName(pairs).groupBy("a", "b").agg(F.max("m").alias("m")), nodes), "pairs")
    sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("node")), df, id_col, text_col, nodes)
    comps = common.stage_table(graph.components(verified(likely, sets)), "components")
    common.discard(likely, sets)
    rows = open_lists(rows, comps)
    common.discard(lists)
    if not rows.take(1):
        return comps
    sets = sets_of(rows.select("node"), df, id_col, text_col, nodes)
    rows = open_lists(rows.join(_able(sets), "node", "left_semi").select("value", "node", "n"), comps)
    found = block_links(_families(rows, sets))
    return common.stage_table(graph.components(found.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))), "components")


def _nodes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (node, sig, min_id, first, comp) of all nodes, which are numbered as their table is written; first is the node's row of the smallest id and text hash, NULL ids last."""
    rows = common.stage_table(sketches(df, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    nodes = common.stage_table(rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("id").alias("min_id"), first, F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    comps = links(df, id_col, text_col, nodes)
    return rows, nodes.select("node", "sig", "min_id", "first").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row; a component keeps its smallest id."""
    rows, ids = _nodes(df, id_col, text_col)
    least = ids.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    named = ids.join(least, "comp").select("sig", "component_id")
    out = rows.select("id", "n", "sig").join(named, "sig", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_each(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each component: that of the smallest id (NULL last) and, within it, of the smallest text hash.

    Rows without words are linked with nothing, so all of them stay.
    """
    first = _nodes(df, id_col, text_col)[1].groupBy("comp").agg(F.min("first").alias("r")).select(F.col("r.id").alias("_ps_id"), F.col("r.key").alias("_ps_first"))
    text, names = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), [F.col(f"`{c}`") for c in df.columns]
    some = text.rlike(r"[^\t\n\x0B\f\r ]")
    rows = df.where(some).withColumn("_ps_key", text_key(text_col))
    rows = rows.join(first, F.col(f"`{id_col}`").eqNullSafe(F.col("_ps_id")) & (F.col("_ps_key") == F.col("_ps_first")), "left_semi")
    # rows of one id and text are in one component
    rows = rows.groupBy(F.col(f"`{id_col}`").alias("_ps_id"), "_ps_key").agg(F.min(F.struct(*names)).alias("_ps_row")).select("_ps_row.*")
    return df.where(~some).unionByName(rows)
