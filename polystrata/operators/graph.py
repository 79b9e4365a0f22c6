"""Graph operators over an edge table ``(from_id, to_id, type, ...)``.

Loops run on the driver, joins on the cluster.  Each round is written to the shared
folder (``spark.checkpoint.dir``) where one is set, so plans stay short and lost
executors cost a round at most; without one the plan is cut by ``checkpoint()`` into
a temporary folder (local mode).
"""

from __future__ import annotations

import itertools
import tempfile
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..plans import nodes as N

if TYPE_CHECKING:
    from ..engine import Engine
    from ..plans.lower import Lowering


def settle(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise GraphError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="polystrata-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def oriented(edges: DataFrame, direction: str, extra: list[str] | None = None) -> DataFrame:
    """(src, dst, *extra) as the direction asks: out, in or both."""
    extra = extra or []
    out = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), *extra)
    back = edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), *extra)
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


class Graph:
    """Graph operations of an engine."""

    def __init__(self, engine: Engine, edge_table: str = "relationships", cap: int = 10, undirected_arrows: bool = False):
        self.engine, self.edge_table, self.cap, self.undirected_arrows = engine, edge_table, cap, undirected_arrows

    def edges(self, types: list[str] | None = None) -> DataFrame:
        df = self.engine.catalog.scan(self.edge_table)
        return df.where(F.col("type").isin(types)) if types else df

    # -- traversal --------------------------------------------------------

    def reach(self, starts: DataFrame, edges: DataFrame, low: int, high: int | None, direction: str) -> DataFrame:
        """(start_id, node_id, depth): nodes whose shortest distance from a start lies in [low, high].

        ``starts``: one column ``start_id``.  The start itself is at depth 0 and is not returned for low > 0.
        Without ``high`` the search goes on until it finds nothing new; it raises if that takes more
        than the engine's cap, as paths would be missing.
        """
        steps = oriented(edges, direction).distinct()
        if high is None or high > 1:
            steps = settle(steps)  # the edge table is computed once, not in every hop
        open_end, high = high is None, self.cap if high is None else high
        seen = starts.select("start_id", F.col("start_id").alias("node_id"), F.lit(0).alias("depth")).distinct()
        frontier = seen
        for depth in range(1, high + 1):
            step = frontier.join(steps, frontier["node_id"] == steps["src"]).select("start_id", F.col("dst").alias("node_id")).distinct()
            frontier = step.join(seen.select("start_id", "node_id"), ["start_id", "node_id"], "left_anti").withColumn("depth", F.lit(depth))
            if high > 2:
                frontier = settle(frontier)
                if not frontier.take(1):
                    break
                if open_end and depth == high and frontier.join(steps, frontier["node_id"] == steps["src"]).select("start_id", F.col("dst").alias("node_id")).join(seen.unionByName(frontier).select("start_id", "node_id"), ["start_id", "node_id"], "left_anti").take(1):
                    raise GraphError(f"paths go on after {high} hops; raise the engine's hop_cap or name a longest length")
            seen = seen.unionByName(frontier)
        return seen.where((F.col("depth") >= low) & (F.col("depth") <= high))

    def _label(self, pattern: N.NodePattern, fallback: str | None) -> DataFrame | None:
        name = pattern.label or fallback
        if name is None:
            return None
        table, _, kind = name.partition(".")
        return self.engine.catalog.scan(table, kind or None)

    def _one(self, p: N.Pattern, k: int, lowering: Lowering, fallback: str | None) -> DataFrame:
        from ..plans.lower import Scope

        starts = self._label(p.start, fallback)
        if starts is None:
            raise GraphError("a pattern without a start label needs FROM")
        if p.start.where is not None:
            starts = starts.where(lowering.col(p.start.where, Scope(starts, {("", c): c for c in starts.columns}, [])))
        a, b, r = p.start.var or f"_a{k}", p.end.var or f"_b{k}", p.edge.var or f"_r{k}"
        edges = self.edges([p.edge.type] if p.edge.type else None)
        if p.edge.where is not None:
            edges = edges.where(lowering.col(p.edge.where, Scope(edges, {("", c): c for c in edges.columns}, [])))
        high = p.edge.high
        if p.edge.low > (self.cap if high is None else high):
            raise GraphError("a path's shortest length is over its longest")
        direction = "both" if self.undirected_arrows else p.edge.direction
        found = self.reach(starts.select(F.col("id").alias("start_id")), edges, p.edge.low, high, direction)
        ends = self._label(p.end, None)
        if ends is not None:
            if p.end.where is not None:
                ends = ends.where(lowering.col(p.end.where, Scope(ends, {("", c): c for c in ends.columns}, [])))
            found = found.join(ends.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")
        rows = starts.select(F.col("id").alias("start_id")).distinct().join(found, "start_id", "left" if p.edge.optional else "inner")
        return rows.select(
            F.col("start_id").alias(a),
            F.col("start_id").alias(f"{a}_id"),
            F.col("node_id").alias(b),
            F.col("node_id").alias(f"{b}_id"),
            F.when(F.col("depth").isNotNull(), F.concat(F.lit("path_depth_"), F.col("depth"))).alias(r),
        )

    def traverse(self, patterns: tuple[N.Pattern, ...], lowering: Lowering, fallback: str | None = None) -> DataFrame:
        """Bindings of all patterns; patterns that share variables are joined on them, others are crossed."""
        out = None
        for k, p in enumerate(patterns):
            rows = self._one(p, k, lowering, fallback)
            if out is None:
                out = rows
                continue
            shared = [c for c in out.columns if c in rows.columns]
            out = out.join(rows, shared) if shared else out.crossJoin(rows)
        return out.select(*[c for c in out.columns if not c.startswith("_")])

    # -- algorithms -------------------------------------------------------

    def shortest_path(self, source: str, target: str | None = None, types: list[str] | None = None, direction: str = "out", most: int | None = None) -> DataFrame:
        """(node_id, distance, path) of the fewest hops from ``source``; ties take the smallest path.

        The search ends when it finds nothing new, or ``target``, or after ``most`` hops if the caller names a limit.
        """
        steps = settle(oriented(self.edges(types), direction).distinct())
        spark = self.engine.spark
        seen = spark.range(1).select(F.lit(source).alias("node_id"), F.lit(0).alias("distance"), F.array(F.lit(source)).alias("path"))
        frontier = seen
        for d in itertools.count(1):
            if most is not None and d > most:
                break
            step = frontier.join(steps, frontier["node_id"] == steps["src"]).select(F.col("dst").alias("node_id"), F.lit(d).alias("distance"), F.concat("path", F.array("dst")).alias("path"))
            step = step.groupBy("node_id", "distance").agg(F.min("path").alias("path")).join(seen.select("node_id"), "node_id", "left_anti")
            frontier = settle(step)
            if not frontier.take(1):
                break
            seen = settle(seen.unionByName(frontier))
            if target is not None and frontier.where(F.col("node_id") == target).take(1):
                break
        return seen if target is None else seen.where(F.col("node_id") == target)

    def weighted_paths(self, source: str, weight: str = "weight", types: list[str] | None = None, direction: str = "out", most: int | None = None) -> DataFrame:
        """(node_id, cost) of the cheapest paths from ``source`` (Bellman-Ford rounds; weights of 0 or more).

        Rounds go on until no cost falls; more than ``most`` raise, as costs would not be settled.
        """
        steps = settle(oriented(self.edges(types), direction, [weight]))
        if steps.where(F.col(weight) < 0).take(1):
            raise GraphError("weights are 0 or more")
        best = self.engine.spark.range(1).select(F.lit(source).alias("node_id"), F.lit(0.0).alias("cost"))
        frontier = best
        for k in itertools.count():
            if most is not None and k >= most:
                raise GraphError(f"costs still fall after {most} rounds")
            step = frontier.join(steps, frontier["node_id"] == steps["src"]).groupBy(F.col("dst").alias("node_id")).agg(F.min(F.col("cost") + F.col(weight)).alias("new"))
            better = step.join(best, "node_id", "left").where(F.col("cost").isNull() | (F.col("new") < F.col("cost"))).select("node_id", F.col("new").alias("cost"))
            frontier = settle(better)
            if not frontier.take(1):
                break
            best = settle(best.join(frontier.select("node_id"), "node_id", "left_anti").unionByName(frontier))
        return best

    def simple_paths(self, source: str, target: str, most: int = 4, types: list[str] | None = None, direction: str = "out") -> DataFrame:
        """(path, length): every path without repeated nodes of at most ``most`` hops. Their number can be exponential in ``most``."""
        steps = oriented(self.edges(types), direction).distinct()
        rows = self.engine.spark.range(1).select(F.lit(source).alias("node_id"), F.array(F.lit(source)).alias("path"))
        out = None
        for _ in range(most):
            rows = rows.join(steps, rows["node_id"] == steps["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node_id"), F.concat("path", F.array("dst")).alias("path"))
            hit = rows.where(F.col("node_id") == target)
            out = hit if out is None else out.unionByName(hit)
            rows = rows.where(F.col("node_id") != target)
        return out.select("path", (F.size("path") - 1).cast("long").alias("length"))

    def nodes(self, edges: DataFrame) -> DataFrame:
        return oriented(edges, "both").select(F.col("src").alias("id")).distinct()

    def connected_components(self, types: list[str] | None = None, most: int | None = None) -> DataFrame:
        """(id, component): the smallest id that undirected paths reach; alternating large and small stars until they settle.

        More than ``most`` rounds raise; the number of rounds grows with the logarithm of the longest path.
        """
        edges = self.edges(types)
        nodes = self.nodes(edges)
        stars = settle(edges.select(F.greatest("from_id", "to_id").alias("a"), F.least("from_id", "to_id").alias("b")).where("a <> b").distinct())
        before = None
        for k in itertools.count():
            if most is not None and k >= most:
                raise GraphError(f"components did not settle in {most} rounds")
            both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            down = large.groupBy("a").agg(F.min("b").alias("m"))
            pairs = large.join(down, "a").select(F.inline(F.array(F.struct(F.col("b").alias("u"), F.col("m").alias("v")), F.struct(F.col("a").alias("u"), F.col("m").alias("v")))))
            stars = settle(pairs.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())
            state = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if state == before:
                break
            before = state
        return nodes.join(stars.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))

    def pagerank(self, iterations: int = 10, damping: float = 0.85, types: list[str] | None = None) -> DataFrame:
        """(id, rank); ranks sum to 1, the rank of nodes without outgoing edges is shared by all."""
        edges = self.edges(types).select("from_id", "to_id").distinct()
        nodes = settle(self.nodes(edges))
        n = nodes.count()
        if not n:
            return nodes.withColumn("rank", F.lit(1.0))
        links = settle(edges.join(edges.groupBy("from_id").agg(F.count(F.lit(1)).alias("degree")), "from_id"))
        ranks = nodes.withColumn("rank", F.lit(1.0 / n))
        for k in range(iterations):
            sent = links.join(ranks, links["from_id"] == ranks["id"]).groupBy("to_id").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
            # what dangling nodes hold is 1 minus all that is sent
            lost = 1.0 - (sent.agg(F.sum("got")).first()[0] or 0.0)
            ranks = nodes.join(sent, nodes["id"] == sent["to_id"], "left").select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"))
            ranks = settle(ranks)
        return ranks

    def label_propagation(self, iterations: int = 5, types: list[str] | None = None) -> DataFrame:
        """(id, community): each round a node takes its neighbours' most common label, ties the smallest."""
        steps = settle(oriented(self.edges(types), "both").distinct())
        labels = self.nodes(self.edges(types)).withColumn("community", F.col("id"))
        for _ in range(iterations):
            votes = steps.join(labels, steps["src"] == labels["id"]).groupBy("dst", "community").agg(F.count(F.lit(1)).alias("c"))
            labels = settle(votes.groupBy(F.col("dst").alias("id")).agg(F.min_by("community", F.struct(-F.col("c"), F.col("community"))).alias("community")))
        return labels

    def closeness_centrality(self, types: list[str] | None = None, direction: str = "both") -> DataFrame:
        """(id, reached, closeness): nodes that a node reaches, over the sum of its distances to them; 0 if there are none.

        Breadth-first search from every node at once: a row per pair of connected nodes.
        """
        edges = self.edges(types)
        starts = self.nodes(edges).select(F.col("id").alias("start_id"))
        steps = settle(oriented(edges, direction).distinct())
        seen = frontier = settle(starts.select("start_id", F.col("start_id").alias("node_id"), F.lit(0).alias("depth")))
        for depth in itertools.count(1):
            step = frontier.join(steps, frontier["node_id"] == steps["src"]).select("start_id", F.col("dst").alias("node_id")).distinct()
            frontier = settle(step.join(seen.select("start_id", "node_id"), ["start_id", "node_id"], "left_anti").withColumn("depth", F.lit(depth)))
            if not frontier.take(1):
                break
            seen = settle(seen.unionByName(frontier))
        total = F.sum("depth")
        return seen.groupBy(F.col("start_id").alias("id")).agg((F.count(F.lit(1)) - 1).alias("reached"), F.coalesce(F.try_divide((F.count(F.lit(1)) - 1).cast("double"), total), F.lit(0.0)).alias("closeness"))

    def degree_centrality(self, types: list[str] | None = None) -> DataFrame:
        """(id, out_degree, in_degree, centrality): degree over the number of other nodes."""
        edges = self.edges(types)
        ends = edges.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        out = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        n = out.count()
        total: Column = (F.col("out_degree") + F.col("in_degree")).cast("double")
        return out.withColumn("centrality", total / max(n - 1, 1))
