"""Communities by modularity: local moves, refinement into well-connected parts, aggregation, and splits of what is still too large.

Graphs are edge tables (src, dst, weight), undirected, each edge once. A graph of at most `task_edges` edges, and every subgraph of a split,
is worked on in one group. Of a larger one each connected component is a group, since no gain reaches beyond a component but by the weight of the
whole graph, which a group is told; only components that are themselves larger go in rounds of Spark jobs, which end when their aggregate is small
enough for a group. All paths move nodes by the same gain; the bound is a parameter and what a group holds is bounded by it.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, written
from ..workers import findable
from . import graph

TASK_EDGES = 2_000_000


class _Near:
    """The neighbours of each node and their weights, in three arrays."""

    def __init__(self, sizes: np.ndarray, to: np.ndarray, weight: np.ndarray):
        self.ends, self.to, self.weight = [0, *np.cumsum(sizes).tolist()], to, weight

    def __getitem__(self, v: int) -> Iterator[tuple[int, float]]:
        x, y = self.ends[v], self.ends[v + 1]
        return zip(self.to[x:y].tolist(), self.weight[x:y].tolist())


class _Graph:
    """A graph in one task: neighbours and weights of each node without loops, degrees with them. two_m: that of the graph it is a part of."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, two_m: float | None = None):
        self.n = n
        self.degree = np.bincount(src, weight, n) + np.bincount(dst, weight, n)
        other = src != dst
        a, b, w = np.concatenate([src[other], dst[other]]), np.concatenate([dst[other], src[other]]), np.concatenate([weight[other]] * 2)
        order = np.argsort(a, kind="stable")
        self.near = _Near(np.bincount(a, minlength=n), b[order].astype(np.int32), w[order])
        self.edges = (src, dst, weight)
        self.two_m = float(self.degree.sum()) if two_m is None else two_m

    def aggregate(self, part: np.ndarray, parts: int) -> _Graph:
        src, dst, weight = self.edges
        a, b = np.minimum(part[src], part[dst]), np.maximum(part[src], part[dst])
        key, where = np.unique(a * parts + b, return_inverse=True)
        return _Graph(parts, key // parts, key % parts, np.bincount(where, weight), self.two_m)

    def quality(self, community: np.ndarray, resolution: float) -> float:
        src, dst, weight = self.edges
        inside = weight[community[src] == community[dst]].sum()
        total = np.bincount(community, self.degree)
        return 2 * inside / self.two_m - resolution * (total * total).sum() / self.two_m**2


def _move(g: _Graph, community: list[int], resolution: float, order: list[int]) -> bool:
    """Moves each node to the neighbouring community of largest gain, or to an empty one, until none gains; whether any moved."""
    k, scale = g.degree.tolist(), resolution / g.two_m
    total, size = [0.0] * g.n, [0] * g.n
    for v, c in enumerate(community):
        total[c] += k[v]
        size[c] += 1
    empty = [c for c in range(g.n) if not size[c]]
    waits, queue, any_moved = [True] * g.n, deque(order), False
    while queue:
        v = queue.popleft()
        waits[v] = False
        own, kv = community[v], k[v]
        toward: dict[int, float] = {}
        for u, w in g.near[v]:
            c = community[u]
            toward[c] = toward.get(c, 0.0) + w
        total[own] -= kv
        size[own] -= 1
        best, most = own, toward.get(own, 0.0) - scale * kv * total[own]
        for c, w in toward.items():
            gain = w - scale * kv * total[c]
            if gain > most + 1e-12 or (gain > most - 1e-12 and best != own and c < best):
                best, most = c, gain
        if most < -1e-12 and size[own] and empty:
            best = empty.pop()
        total[best] += kv
        size[best] += 1
        if best != own:
            any_moved = True
            community[v] = best
            if not size[own]:
                empty.append(own)
            for u, _ in g.near[v]:
                if not waits[u] and community[u] != best:
                    waits[u] = True
                    queue.append(u)
    return any_moved


def _refine(g: _Graph, community: list[int], resolution: float, order: list[int]) -> list[int]:
    """Parts of the communities: each node that is well connected to its community joins the well-connected part of largest gain."""
    k, scale = g.degree.tolist(), resolution / g.two_m
    whole = [0.0] * g.n
    for v, c in enumerate(community):
        whole[c] += k[v]
    inside = [sum(w for u, w in g.near[v] if community[u] == community[v]) for v in range(g.n)]
    part, total, out, alone = list(range(g.n)), list(k), list(inside), [True] * g.n
    for v in order:
        rest = whole[community[v]] - k[v]
        if not alone[v] or inside[v] < scale * k[v] * rest:
            continue
        toward: dict[int, float] = {}
        for u, w in g.near[v]:
            if community[u] == community[v]:
                toward[part[u]] = toward.get(part[u], 0.0) + w
        best, most = v, 0.0
        for c, w in toward.items():
            gain = w - scale * k[v] * total[c]
            if c != v and gain > most + 1e-12 and out[c] >= scale * total[c] * (whole[community[v]] - total[c]) - 1e-12:
                best, most = c, gain
        if best != v:
            part[v] = best
            alone[v] = alone[best] = False
            out[best] += inside[v] - 2 * toward[best]
            total[best] += k[v]
    return part


def leiden(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, resolution: float = 1.0, seed: int = 42, tries: int = 4, two_m: float | None = None) -> np.ndarray:
    """The community (0 ...) of each of n nodes. Repeated from its own result while the modularity grows, at most `tries` times.

    two_m: twice the weight of the graph whose modularity counts, where this one is all of some of its components."""
    first, rng = _Graph(n, src, dst, weight, two_m), random.Random(seed)
    found = np.arange(n)
    if first.two_m <= 0:
        return found
    most = -np.inf
    for _ in range(tries):
        g, of = first, np.arange(n)
        community = found.tolist()
        while True:
            order = list(range(g.n))
            rng.shuffle(order)
            moved = _move(g, community, resolution, order)
            part, names = np.unique(_refine(g, community, resolution, order), return_inverse=True)
            if len(part) == g.n or not moved and len(set(community)) == g.n:
                break
            up = np.zeros(len(part), np.int64)
            up[names] = community
            _, community = np.unique(up, return_inverse=True)
            community, g, of = community.tolist(), g.aggregate(names, len(part)), names[of]
        _, now = np.unique(np.array(community)[of], return_inverse=True)
        quality = first.quality(now, resolution)
        if quality <= most + 1e-9:
            break
        found, most = now, quality
    return found


def _in_groups(edges: DataFrame, resolution: float, seed: int, two_m: float | None = None) -> DataFrame:
    """(part, node, community) of graphs (part, src, dst, weight) that each fit in a task; a community is named by its smallest node. Parts are dealt
    over the tasks by their edges."""
    kinds = {c: edges.schema[c].dataType.simpleString() for c in ("part", "src")}

    def work(group: pd.DataFrame) -> pd.DataFrame:
        node, at = np.unique(np.concatenate([group["src"].to_numpy(), group["dst"].to_numpy()]), return_inverse=True)
        src, dst = np.split(at, 2)
        order = np.lexsort((dst, src))
        found = leiden(len(node), src[order], dst[order], group["weight"].to_numpy(np.float64)[order], resolution, seed, two_m=two_m)
        _, first = np.unique(found, return_index=True)  # nodes are sorted, so the first is the smallest
        return pd.DataFrame({"part": group["part"].iloc[0], "node": node, "community": node[first][found]})

    spark = edges.sparkSession
    findable(spark)
    dealt = edges.select("part", "src", "dst", "weight").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    return dealt.groupBy("part").applyInPandas(work, f"part {kinds['part']}, node {kinds['src']}, community {kinds['src']}")


def _moves(edges: DataFrame, resolution: float, patience: int, two_m: float) -> DataFrame:
    """(node, community) by local moves of many nodes at once, in rounds; loops count in the degrees only.

    Each round every node looks at its neighbours' communities and the best gain wins (ties: the smaller name); only nodes of one of some hash
    classes move in a round, so that two neighbours do not swap for ever, and the classes grow in number with the rounds. It ends when no
    node would gain by a move, or when the modularity has not grown for `patience` rounds: then with the best state met.
    """
    ends = graph.both_ways(edges.select("src", "dst", "weight"))
    k = written(ends.groupBy("src").agg(F.sum("weight").alias("k")).withColumnRenamed("src", "node"))
    e = written(ends.where("src <> dst"))
    loops = edges.where("src = dst").select(F.col("src").alias("node"), (2 * F.col("weight")).alias("loop"))
    state = best = written(k.join(loops, "node", "left").select("node", "k", F.coalesce("loop", F.lit(0.0)).alias("loop"), F.col("node").alias("community")))
    most, worse, r = float("-inf"), 0, 0
    while True:
        total = state.groupBy("community").agg(F.sum("k").alias("tot"))
        near = e.join(state.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w")).withColumnRenamed("src", "node")
        mine = state.select("node", "k", "loop", F.col("community").alias("own"))
        options = near.unionByName(mine.select("node", F.col("own").alias("community"), F.lit(0.0).alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w")).join(mine, "node").join(total, "community")
        stays = F.col("community") == F.col("own")
        gain = F.round(F.col("w") - F.lit(resolution) * F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / F.lit(two_m), 9)
        inside = F.max(F.when(stays, F.col("w") + F.col("loop") - F.lit(resolution) * F.col("k") * F.col("tot") / F.lit(two_m)))
        better = F.struct(-gain, (~stays).cast("int"), F.col("community"))
        found = options.groupBy("node", "k", "loop", "own").agg(F.min_by("community", better).alias("best"), inside.alias("inside"))
        classes = 2 + r // 8
        moves = F.pmod(F.xxhash64("node", F.lit(r // classes)), F.lit(classes)) == r % classes
        next_ = written(found.select("node", "k", "loop", F.when(moves, F.col("best")).otherwise(F.col("own")).alias("community"), (F.col("best") != F.col("own")).alias("wants"), "inside"))
        seen = next_.agg(F.coalesce(F.sum("inside"), F.lit(0.0)).alias("q"), F.max("wants").alias("wants")).first()
        worse = 0 if seen["q"] / two_m > most + 1e-7 else worse + 1
        if not worse:
            most, best, old = seen["q"] / two_m, state, best
            discard(old if old is not state else None)
        elif state is not best:
            discard(state)
        if worse > patience or not seen["wants"]:
            out = written(best.select("node", "community"))
            discard(best, next_, e, k)
            return out
        state, r = next_, r + 1


def _weight(edges: DataFrame) -> float:
    """Twice the weight of all edges, to 12 digits: the last ones depend on the order of the sum."""
    return float(f"{2 * edges.agg(F.sum('weight')).first()[0]:.12g}") or 1.0


def _in_rounds(edges: DataFrame, resolution: float, seed: int, task_edges: int, patience: int, two_m: float) -> DataFrame:
    """(node, community) of components of any size: rounds of moves, connected parts, their aggregate; the last level in one group."""
    level, of = written(edges.select("src", "dst", "weight")), None
    while level.count() > task_edges:
        state = _moves(level, resolution, patience, two_m)
        inner = level.join(state.toDF("src", "cs"), "src").join(state.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst")
        parts = written(graph.components(inner, state))
        nodes, left = parts.count(), parts.select("component").distinct().count()
        of, old = written(parts.toDF("node", "community") if of is None else of.join(parts.toDF("community", "part"), "community").select("node", F.col("part").alias("community"))), of
        discard(old, state)
        if left > 0.95 * nodes:  # a coarser graph would be as large: these parts stand
            discard(level, parts)
            return of
        a, b = (F.least("a", "b"), F.greatest("a", "b"))
        ends = level.join(parts.toDF("src", "a"), "src").join(parts.toDF("dst", "b"), "dst")
        level, old = written(ends.groupBy(a.alias("src"), b.alias("dst")).agg(F.sum("weight").alias("weight"))), level
        discard(old, parts)
    last = _in_groups(level.withColumn("part", F.lit(0)), resolution, seed, two_m).select(F.col("node").alias("community"), F.col("community").alias("name"))
    if of is None:
        return last.select(F.col("community").alias("node"), F.col("name").alias("community"))
    named = of.join(last, "community", "left").select("node", F.coalesce("name", "community").alias("name"))
    smallest = named.groupBy("name").agg(F.min("node").alias("community"))
    return named.join(smallest, "name").select("node", "community")


def _by_component(edges: DataFrame, resolution: float, seed: int, task_edges: int, patience: int) -> DataFrame:
    """(node, community) of one graph of any size: its components in groups, those of more than task_edges edges in rounds.

    A component of more than an eighth of task_edges has a group of its own; smaller ones share groups of about a quarter.
    """
    two_m = _weight(edges)
    if not task_edges:
        return _in_rounds(edges, resolution, seed, task_edges, patience, two_m)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    of = written(graph.components(edges, nodes).select(F.col("node").alias("src"), "component"))
    placed = written(edges.join(of, "src"))
    sizes = written(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    shared = F.col("n") * 8 <= task_edges
    total = sizes.where(shared).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(1, -(-4 * total // task_edges))
    part = F.when(shared, F.concat(F.lit("shared "), F.pmod(F.xxhash64("component"), F.lit(bins)))).otherwise(F.concat(F.lit("own "), F.col("component").cast("string")))
    each = written(placed.join(sizes.where(F.col("n") <= task_edges), "component").select(part.alias("part"), "src", "dst", "weight"))
    found = written(_in_groups(each, resolution, seed, two_m).select("node", "community"))
    large = written(placed.join(sizes.where(F.col("n") > task_edges), "component", "left_semi").select("src", "dst", "weight"))
    if large.take(1):
        found, old = written(found.unionByName(_in_rounds(large, resolution, seed, task_edges, patience, two_m))), found
        discard(old)
    discard(of, placed, sizes, each, large)
    return found


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 42, task_edges: int = TASK_EDGES, patience: int = 2) -> DataFrame:
    """(node, community) of every node with an edge; a community is named by its smallest node. Deterministic.

    task_edges bounds the edges that one task holds; 0 keeps all levels in Spark's rounds. Weights must be positive. No edges: no rows.
    """
    whole = written(edges.select("src", "dst", "weight"))
    if whole.count() > task_edges:
        return _by_component(whole, resolution, seed, task_edges, patience)
    return _in_groups(whole.withColumn("part", F.lit(0)), resolution, seed).select("node", "community")


def hierarchy(edges: DataFrame, most: int = 10, depth: int = 10, resolution: float = 1.0, seed: int = 42, task_edges: int = TASK_EDGES, patience: int = 2) -> DataFrame:
    """(node, level, community, parent, final): the communities of the graph, and those of the subgraph of each that has more than `most` nodes.

    The first partition is of level `depth`, each split one lower, down to 0. parent is the community that was split, of the level above. final: the
    node's community was not split, since it has `most` nodes or fewer, has no better partition than itself, or is of level 0. A community is
    named by its smallest node, so names repeat from level to level only.
    """
    rest = written(edges.select(F.col("src").alias("part"), "src", "dst", "weight"))
    first, out = True, None
    for level in range(depth, -1, -1):
        if first:
            found = written(communities(rest, resolution, seed, task_edges, patience).withColumn("parent", F.expr("CAST(NULL AS STRING)").cast(edges.schema["src"].dataType)))
        else:
            sizes = rest.groupBy("part").agg(F.count(F.lit(1)).alias("edges")).where(F.col("edges") > task_edges)
            large = [r["part"] for r in sizes.select("part").collect()]  # fewer than all edges / task_edges
            small = rest.where(~F.col("part").isin(large)) if large else rest
            parts = _in_groups(small, resolution, seed).select("node", "community", F.col("part").alias("parent"))
            for part in large:
                parts = parts.unionByName(communities(rest.where(F.col("part") == part), resolution, seed, task_edges, patience).withColumn("parent", F.lit(part)))
            parts = written(parts)  # read twice
            divided = parts.groupBy("parent").agg(F.countDistinct("community").alias("n")).where("n > 1").select("parent")
            found = written(parts.join(divided, "parent").select("node", "community", "parent"))
        sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
        inner = rest.join(found.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(found.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst").where("a = b")
        again = inner.join(sizes.where(F.col("n") > most), F.col("a") == F.col("community"), "left_semi").select(F.col("a").alias("part"), "src", "dst", "weight")
        rows = found.withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
        rest, old, first = written(again), rest, False
        discard(old)
        if not rest.take(1):
            break
    split = out.where("parent IS NOT NULL").select((F.col("level") + 1).alias("level"), F.col("parent").alias("community"), F.lit(True).alias("split")).distinct()
    return out.join(split, ["level", "community"], "left").select("node", "level", "community", "parent", F.col("split").isNull().alias("final"))


def build_hierarchy(found: DataFrame) -> DataFrame:
    """(level, community, parent, entity_count, rank, final) of hierarchy()'s rows: rank is a tenth of the size, at most 10."""
    made = found.groupBy("level", "community").agg(F.first("parent").alias("parent"), F.count(F.lit(1)).alias("entity_count"), F.first("final").alias("final"))
    return made.select("level", "community", "parent", "entity_count", F.least(F.col("entity_count") / 10.0, F.lit(10.0)).alias("rank"), "final")
