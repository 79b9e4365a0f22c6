"""Connected components of a large edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the component's smallest node.

    Each round every node hands its neighbours to the smallest one it knows; edges
    shrink towards stars, and their number does not grow.  Rounds grow with the
    logarithm of the longest path.  A round is staged in the shared folder; only
    counts come to the driver.
    """
    stars = common.stage_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    before = None
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: so do the smaller neighbours and the node itself
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        last, stars = stars, common.stage_table(small, "stars")
        common.discard(last)
        state = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
