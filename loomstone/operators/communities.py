"""Communities of a graph over time: what waits, what an update touches, new and orphaned ones, stale reports, contexts of communities.

Tables: members (node, community), edges (src, dst, weight), communities (community, level, parent, entity_count, rank), reports
(community, stale, updated_at, vector). Texts of reports and answers are the caller's model's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable
from . import graph, health, leiden, retrieval, vector_index


def pending(nodes: DataFrame, members: DataFrame, node: str = "node") -> DataFrame:
    """Nodes without a community."""
    return nodes.select(F.col(node).alias("node")).distinct().join(members.select("node").distinct(), "node", "left_anti")


def without_report(communities: DataFrame, reports: DataFrame) -> DataFrame:
    return communities.join(reports.select("community").distinct(), "community", "left_anti")


def stale_by_age(reports: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Reports that are marked stale or older than `days`."""
    return reports.where(F.coalesce("stale", F.lit(False)) | (F.col("updated_at") < now - F.expr(f"INTERVAL {days} DAYS")))


def affected(nodes: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community): those of the nodes and of their neighbours."""
    near = graph.both_ways(edges).join(nodes.select(F.col("node").alias("src")).distinct(), "src").select(F.col("dst").alias("node"))
    return members.join(near.unionByName(nodes.select("node")).distinct(), "node").select("community").distinct()


def subgraph(members: DataFrame, edges: DataFrame, chosen: DataFrame, most_edges: int | None = None) -> DataFrame:
    """Edges that touch a member of the chosen communities, each once; with most_edges the heaviest so many (the caller's stated cap)."""
    inside = members.join(chosen.select("community").distinct(), "community", "left_semi").select("node").distinct()
    ends = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(edges.join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)).distinct()
    return ends if most_edges is None else ends.orderBy(F.desc("weight"), "src", "dst").limit(most_edges)


def local_clusters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, community): components of the edges among the nodes."""
    mine = nodes.select("node").distinct()
    inside = edges.join(mine.withColumnRenamed("node", "src"), "src", "left_semi").join(mine.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return graph.components(inside, mine).withColumnRenamed("component", "community")


def incremental_update(members: DataFrame, edges: DataFrame, waiting: DataFrame) -> DataFrame:
    """(node, before, after, change) when communities are found anew around waiting nodes only.

    The affected communities' subgraph, with the edges among waiting nodes, is clustered; a cluster that holds members keeps the community that most of them had (the smaller of
    equal ones), and each community goes on in its largest cluster; other clusters are named by their smallest node. Nodes outside the
    subgraph are not touched.
    """
    mine = waiting.select("node").distinct()
    among = edges.join(mine.withColumnRenamed("node", "src"), "src", "left_semi").join(mine.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)
    near = subgraph(members, edges, affected(waiting, members, edges)).select(*edges.columns).unionByName(among).distinct()
    nodes = near.select(F.col("src").alias("node")).unionByName(near.select(F.col("dst").alias("node"))).unionByName(waiting.select("node")).distinct()
    clusters = local_clusters(near, nodes)
    old = nodes.join(members, "node", "left").select("node", F.col("community").alias("before"))
    votes = clusters.join(old.where("before IS NOT NULL"), "node").groupBy("community", "before").agg(F.count(F.lit(1)).alias("n"))
    heir = votes.groupBy("before").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community"), F.max("n").alias("n"))
    names = heir.groupBy("community").agg(F.min_by("before", F.struct(-F.col("n"), "before")).alias("name"))
    after = clusters.join(names, "community", "left").select("node", F.coalesce(F.col("name").cast("string"), F.concat(F.lit("new:"), F.col("community").cast("string"))).alias("after"))
    both = old.withColumn("before", F.col("before").cast("string")).join(after, "node")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", F.when(F.col("before").isNull(), "assigned").otherwise("moved"))


def apply_changes(members: DataFrame, changes: DataFrame) -> DataFrame:
    """members (node, community as text) after the changes."""
    both = members.select("node", F.col("community").cast("string").alias("community")).join(changes.select("node", "after"), "node", "full")
    return both.select("node", F.coalesce("after", "community").alias("community"))


def mark_stale(members: DataFrame, changes: DataFrame, reports: DataFrame, share: float = 0.1) -> DataFrame:
    """reports with `stale` set where a community's count changed by more than `share` of its present members."""
    moved = changes.select(F.col("before").alias("community"), F.lit(-1).alias("by")).unionByName(changes.select(F.col("after").alias("community"), F.lit(1).alias("by"))).where("community IS NOT NULL").groupBy("community").agg(F.sum("by").alias("change"))
    now = apply_changes(members, changes).groupBy("community").agg(F.countDistinct("node").alias("present"))
    hit = now.join(moved, "community").where(F.abs("change") > share * F.col("present")).select("community", F.lit(True).alias("__hit"))
    return reports.withColumn("community", F.col("community").cast("string")).join(hit, "community", "left").withColumn("stale", F.coalesce("stale", F.lit(False)) | F.coalesce("__hit", F.lit(False))).drop("__hit")


def new_communities(waiting: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, level, entity_count, rank) for nodes without one: a community for each component among them."""
    return health.build_communities(local_clusters(edges, waiting))


def rebuild(table: KeyedTable, nodes: DataFrame, edges: DataFrame, most: int = 10, depth: int = 10, orphans: int = -1, batch: str | None = None) -> DataFrame:
    """Detects all communities anew and puts them (level, community, parent, entity_count, rank) in the table's place, in one commit; its rows.

    Nodes without an edge are one community of level -1, named `orphans`. Until the commit, and if it fails, the old communities stand.
    """
    found = leiden.build_hierarchy(leiden.hierarchy(graph.undirected(edges), most, depth)).drop("final")
    alone = orphan_community(nodes, edges).select("level", F.lit(orphans).cast(found.schema["community"].dataType).alias("community"), F.lit(None).cast(found.schema["parent"].dataType).alias("parent"), "entity_count", "rank")
    table.replace(found.unionByName(alone), batch)
    return table.read()


def orphan_community(nodes: DataFrame, edges: DataFrame, name: str = "orphans") -> DataFrame:
    """One row (community, level -1, entity_count, rank 0) of the nodes without an edge; none without such nodes."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    alone = nodes.select("node").distinct().join(ends, "node", "left_anti")
    return alone.agg(F.count(F.lit(1)).alias("entity_count")).where("entity_count > 0").select(F.lit(name).alias("community"), F.lit(-1).alias("level"), "entity_count", F.lit(0.0).alias("rank"))


def without_orphans(nodes: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an article mentions or an edge touches. mentions (node)."""
    held = mentions.select("node").unionByName(edges.select(F.col("src").alias("node"))).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(held, "node", "left_semi")


def to_archive(articles: DataFrame, followed: DataFrame, now: Column, days: int = 90, key: str = "article", at: str = "at") -> DataFrame:
    """Articles older than `days` that nothing follows. followed (article)."""
    return articles.where(F.col(at) < now - F.expr(f"INTERVAL {days} DAYS")).join(followed.select(key).distinct(), key, "left_anti")


def nearest_reports(reports: DataFrame, queries: DataFrame, communities: DataFrame, level: int = 0, above: float = 0.3, most: int = 10, probes: int | None = None, indexed: bool = False) -> DataFrame:
    """(query, community, score, place) of the reports of a level above a cosine, best first.

    Queries are a stated set, taken in blocks. indexed: the reports are put into a vector index first, of which `probes` lists are searched (None:
    all, exact); else they are compared with every query.
    """
    mine = reports.where("vector IS NOT NULL").join(communities.where(F.col("level") == level).select("community"), "community", "left_semi")
    if indexed:
        found = vector_index.VectorIndex.build(mine, id_col="community", vector="vector").search(queries, most, probes, above, "query", "vector").drop("rank")
    else:
        found = retrieval.knn(mine, queries, most, math.nextafter(above, math.inf), "community", "vector", "query", digits=9).drop("rank")
    pairs = found.select("query", F.col("id").alias("community"), F.col("similarity").alias("score")).where(F.col("score") > above)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "community")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def key_entities(members: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(community, node, degree, place): each community's nodes of highest degree."""
    ends = graph.both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("degree"))
    ranked = members.join(ends, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "node")
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("community", "node", "degree", "place")


def cross_links(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, links, weight), a < b: edges between two communities."""
    ends = lambda end, name: members.select(F.col("node").alias(end), F.col("community").alias(name))
    both = edges.join(ends("src", "cs"), "src").join(ends("dst", "cd"), "dst").where("cs <> cd")
    return both.groupBy(F.least("cs", "cd").alias("a"), F.greatest("cs", "cd").alias("b")).agg(F.count(F.lit(1)).alias("links"), F.sum("weight").alias("weight"))


def global_context(hits: DataFrame, members: DataFrame, edges: DataFrame, entities: int = 5, links: int = 10) -> DataFrame:
    """(query, section, item, place) of a query's communities: the communities, their key entities, links between two of them.

    hits (query, community, place). Sections are built for all queries at once.
    """
    own = hits.select("query", "community", "place")
    first = own.select("query", F.lit("communities").alias("section"), F.col("community").cast("string").alias("item"), F.col("place").cast("long").alias("s"), F.lit(0.0).alias("t"))
    second = own.join(key_entities(members, edges, entities).drop("place"), "community").select("query", F.lit("entities").alias("section"), F.col("node").cast("string").alias("item"), F.lit(0).cast("long").alias("s"), (-F.col("degree")).cast("double").alias("t")).distinct()
    a, b = own.select("query", F.col("community").alias("a")), own.select(F.col("query").alias("q2"), F.col("community").alias("b"))
    third = cross_links(members, edges).join(a, "a").join(b, "b").where("query = q2").select("query", F.lit("links").alias("section"), F.concat_ws(" - ", "a", "b").alias("item"), F.lit(0).cast("long").alias("s"), (-F.col("weight")).cast("double").alias("t"))
    w = Window.partitionBy("query", "section").orderBy("s", "t", "item")
    rows = first.unionByName(second).unionByName(third).withColumn("place", F.row_number().over(w))
    return rows.where((F.col("section") != "links") | (F.col("place") <= links)).select("query", "section", "item", "place")


def map_contexts(hits: DataFrame, members: DataFrame, edges: DataFrame, titles: DataFrame, entities: int = 5) -> DataFrame:
    """(query, community, context): one text for each community of a query, its title and key entities: the map side of an answer."""
    names = key_entities(members, edges, entities).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("node").cast("string").alias("n")))), lambda x: x["n"]), ", ").alias("names"))
    return hits.select("query", "community").join(titles, "community", "left").join(names, "community", "left").select("query", "community", F.concat(F.lit("## "), F.coalesce("title", F.lit("?")), F.lit("\n"), F.coalesce("names", F.lit(""))).alias("context"))


def reduce_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """(query, answers, chars, empty, context): a query's map answers joined for the last call, and what its confidence rests on."""
    t = F.coalesce(F.col(answer), F.lit(""))
    return answers.groupBy("query").agg(F.count(F.lit(1)).alias("answers"), F.sum(F.length(t)).alias("chars"), F.count(F.when(F.trim(t) == "", 1)).alias("empty"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("community", t.alias("t")))), lambda x: x["t"]), "\n").alias("context"))


def follow_up(primer: DataFrame, questions: DataFrame, answers: DataFrame, most: int = 2, enough: float = 0.7) -> DataFrame:
    """(query, asked, confidence, mode): follow-up questions in order until an answer is confident enough or `most` are asked.

    primer (query, communities, confidence); questions (query, place, question); answers (question, confidence). A query without
    communities falls back to a local search.
    """
    put = questions.where(F.col("place") <= most).join(answers, "question", "left").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("confidence", F.lit(0.0)).alias("c")))).alias("steps"))
    start = F.struct(F.lit(0).cast("long").alias("asked"), F.col("confidence").cast("double").alias("c"))
    walk = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<place:int,c:double>>")), start, lambda s, x: F.when(s["c"] >= enough, s).otherwise(F.struct((s["asked"] + 1).alias("asked"), F.greatest(s["c"], x["c"]).alias("c"))))
    kind = F.when(F.coalesce("communities", F.lit(0)) == 0, "local")
    both = primer.join(put.withColumn("steps", F.col("steps").cast("array<struct<place:int,c:double>>")), "query", "left").withColumn("w", walk)
    return both.select("query", F.when(kind == "local", F.lit(0)).otherwise(F.col("w.asked")).cast("long").alias("asked"), F.when(kind == "local", F.col("confidence")).otherwise(F.col("w.c")).alias("confidence"), F.coalesce(kind, F.lit("follow_up")).alias("mode"))


def report_inputs(members: DataFrame, edges: DataFrame, entities: int = 50, relations: int = 30) -> DataFrame:
    """(community, nodes, links): what a report is written from: its nodes of highest degree and heaviest inner edges."""
    nodes = key_entities(members, edges, entities).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("nodes"))
    inner = edges.join(members.select(F.col("node").alias("src"), "community"), "src").join(members.select(F.col("node").alias("dst"), F.col("community").alias("other")), "dst").where("community = other")
    w = Window.partitionBy("community").orderBy(F.desc("weight"), "src", "dst")
    links = inner.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= relations).groupBy("community").agg(F.count(F.lit(1)).alias("links"))
    return nodes.join(links, "community", "left").select("community", "nodes", F.coalesce("links", F.lit(0)).alias("links"))



def inner_links(ends: DataFrame, a: str, b: str, item: str, most: int) -> DataFrame:
    """(community, item, weight): links within one community by item, the `most` frequent ones. ends (a, b, item): the communities of both ends."""
    inner = ends.where(F.col(a) == F.col(b)).groupBy(F.col(a).alias("community"), item).agg(F.count(F.lit(1)).alias("weight"))
    return inner.orderBy(F.desc("weight"), item, "community").limit(most)


def mention_triangles(mentions: DataFrame, links: DataFrame, by: str, item: str, link_key: str, other: str) -> DataFrame:
    """(by, e1, e2), e1 < e2: two items of one article of which the second has a link that shares `other` with the first's mention."""
    one = mentions.select(by, F.col(item).alias("e1"), F.col(other).alias("shared"))
    two = mentions.select(by, F.col(item).alias("e2"))
    closed = links.select(F.col(link_key).alias("e2"), F.col(other).alias("shared")).distinct()
    return one.join(two, by).where("e1 < e2").join(closed, ["e2", "shared"], "left_semi").select(by, "e1", "e2").distinct()
