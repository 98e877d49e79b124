"""Graph analytics on edge tables: components, hops, degrees, modularity, merge chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, written


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = "weight") -> DataFrame:
    """(src, dst, weight) with src < dst; parallel edges keep the largest weight; loops go."""
    w = F.col(weight) if weight else F.lit(1.0)
    return edges.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), w.cast("double").alias("weight")).where("src < dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def components(edges: DataFrame, nodes: DataFrame | None = None, node: str = "node") -> DataFrame:
    """(node, component): the smallest node that is reachable. Nodes without edges are their own component.

    Each round hooks every node to its smallest neighbour, follows the pointers to their ends (doubling), and keeps only the edges
    between different ends; rounds grow with the logarithm of a component's size. Tables are written in the shared folder, those of a
    finished round deleted. Where many nodes point to one, the join's input is one shuffle for this join alone, which adaptive
    execution splits.
    """
    pairs = written(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct())
    labels = None
    while pairs.take(1):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        moved, step = True, None
        while moved:
            far = up.toDF("n2", "far")
            step, last = written(up.join(far, F.col("to") == F.col("n2")).select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved"))), step
            discard(last)
            moved, up = bool(step.where("moved").take(1)), step.select("node", "to")
        ends, old = up.toDF("n2", "far"), labels  # nodes of this round are ends of earlier ones
        labels = step.select("node", "to") if old is None else written(old.join(ends, F.col("to") == F.col("n2"), "left").select("node", F.coalesce("far", "to").alias("to")))
        discard(old)
        cut, old = pairs.join(up.toDF("a", "ra"), "a").join(up.toDF("b", "rb"), "b"), pairs
        pairs = written(cut.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct())
        discard(old)
    found = (pairs.toDF("node", "to") if labels is None else labels).toDF("node", "component")
    if nodes is None:
        return found
    return nodes.select(F.col(node).alias("node")).distinct().join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def hops(edges: DataFrame, seeds: DataFrame, depth: int, seed: str = "node") -> DataFrame:
    """(node, hops): all nodes within depth undirected edges of a seed, with their distance; the frontier only is joined."""
    both = both_ways(edges.select("src", "dst")).distinct()
    seen = seeds.select(F.col(seed).alias("node")).distinct().withColumn("hops", F.lit(0))
    front = seen
    for k in range(1, depth + 1):
        front = written(both.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """(node, outgoing, incoming) over distinct neighbours."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0, node: str = "node", group: str = "component") -> DataFrame:
    """One row: modularity of a partition of an undirected weighted graph (0 without edges)."""
    m = membership.select(F.col(node).alias("n"), F.col(group).alias("g"))
    e = edges.join(m.toDF("src", "gs"), "src").join(m.toDF("dst", "gd"), "dst")
    ends = e.select(F.col("gs").alias("g"), "weight", F.when(F.col("gs") == F.col("gd"), F.col("weight")).otherwise(0.0).alias("inside")).unionByName(e.select(F.col("gd").alias("g"), "weight", F.lit(0.0).alias("inside")))
    per = ends.groupBy("g").agg(F.sum("weight").alias("tot"), F.sum("inside").alias("inside"))
    whole = per.agg(F.sum("tot").alias("two_m"), F.sum("inside").alias("inside"), F.sum(F.col("tot") * F.col("tot")).alias("sq"))
    q = F.when(F.col("two_m") > 0, 2 * F.col("inside") / F.col("two_m") - F.lit(resolution) * F.col("sq") / (F.col("two_m") * F.col("two_m"))).otherwise(0.0)
    return whole.select(F.coalesce(q, F.lit(0.0)).alias("modularity"))


def resolve_chains(merges: DataFrame, item: str = "id", into: str = "merged_into", rounds: int = 40) -> DataFrame:
    """(item, final): the end of each merge chain by pointer doubling; null for an item on, or leading to, a cycle."""
    step = merges.where(F.col(into).isNotNull() & (F.col(item) != F.col(into))).select(F.col(item).alias("item"), F.col(into).alias("to"))
    ends = step.select(F.col("to").alias("item")).join(step.select("item"), "item", "left_anti").distinct()
    up = written(step.unionByName(ends.withColumn("to", F.col("item"))))
    for _ in range(rounds):
        far = up.toDF("n2", "far")
        new = written(up.join(far, F.col("to") == F.col("n2")).select("item", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        up, moved = new.select("item", "to"), new.where("moved").take(1)
        if not moved:
            break
    firm = ends.select(F.col("item").alias("n2"), F.lit(True).alias("firm"))
    return up.join(firm, F.col("to") == F.col("n2"), "left").select("item", F.when(F.col("firm"), F.col("to")).alias("final"))


def on_cycles(merges: DataFrame, item: str = "id", into: str = "merged_into") -> DataFrame:
    """(id) of items that a chain of merges leads back to themselves.

    Items that nothing is merged into go first: none of them lies on a cycle. The others are followed as many steps as there are of them, by doubling;
    one whose chain ends on the way goes. Whatever is reached then lies on a cycle.
    """
    step = merges.where(F.col(into).isNotNull()).select(F.col(item).alias("item"), F.col(into).alias("to"))
    up = written(step.join(step.select(F.col("to").alias("item")).distinct(), "item", "left_semi"))
    for _ in range(max(1, up.count()).bit_length() + 1):
        if not up.take(1):
            break
        up, old = written(up.join(up.toDF("n2", "far"), F.col("to") == F.col("n2")).select("item", F.col("far").alias("to"))), up
        discard(old)
    return up.select(F.col("to").alias(item)).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c: every triangle of an undirected graph once; loops and parallel edges do not matter.

    Edges lead from the node of lower degree to that of higher (ties by node), so a node has at most the square root of twice the edges going
    out, and a hub none to its leaves: a star makes no wedge. Wedges of two edges from one node are closed by a semi join with the edges.
    """
    e = written(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct())
    degree = both_ways(e).groupBy("src").agg(F.count(F.lit(1)).alias("d")).withColumnRenamed("src", "node")
    ranked = e.join(degree.toDF("src", "ds"), "src").join(degree.toDF("dst", "dd"), "dst")
    low, high = F.struct("ds", "src"), F.struct("dd", "dst")
    out = ranked.select(F.when(low < high, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(low < high, F.col("dst")).otherwise(F.col("src")).alias("v"))
    out = written(out)
    wedges = out.join(out.toDF("u", "w"), "u").where("v < w")
    closed = wedges.join(e.toDF("v", "w"), ["v", "w"], "left_semi")
    s = F.array_sort(F.array("u", "v", "w"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))
