"""Communities over time, contexts of communities, chains of events and their use, over the driver's tables with their SQL.

Parts are entities; two parts in neighbouring lines of an order, with one quantity, share an edge. A part's size is its community; every
tenth part waits for one. Events of a user are a chain; an error after a purchase within a day is its effect.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import communities, context, graph, health, leiden, memory, retrieval
from ..sources import keyed, tables
from .registry import Registry, table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

_G = "g AS (SELECT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_quantity = b.l_quantity WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2), u AS (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g)"
_M = "m AS (SELECT p_partkey AS node, p_size AS community FROM part WHERE p_partkey % 10 <> 0)"
_ROOTS = "r AS (SELECT n AS node, n AS root FROM nodes UNION SELECT x.dst, r.root FROM r JOIN e x ON x.src = r.node), c AS (SELECT node, min(root) AS component FROM r GROUP BY node)"


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select("l_orderkey", "l_quantity", F.col("l_partkey").alias("a"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    b = li.select("l_orderkey", "l_quantity", F.col("l_partkey").alias("b"), "l_linenumber")
    pairs = a.join(b, ["l_orderkey", "l_quantity", "l_linenumber"]).where("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _members(spark, d):
    return table(spark, d, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("community"))


def _nodes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"))


def _reports(spark, d):
    """A report for each size but each seventh, of the date of the first order of a customer of that number."""
    at = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("community")).agg(F.max("o_orderdate").alias("updated_at"))
    return _members(spark, d).select("community").distinct().where("community % 7 <> 0").join(at, "community", "left").withColumn("stale", F.col("community") % 5 == 0)


_R = "rep AS (SELECT c.community, o.at AS updated_at, c.community % 5 = 0 AS stale FROM (SELECT DISTINCT community FROM m WHERE community % 7 <> 0) c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS at FROM orders GROUP BY 1) o ON o.o_custkey = c.community)"


@R.frame("J7_pending_names", "SELECT p_partkey AS node FROM part WHERE p_partkey % 10 = 0")
def pending_names(spark, d):
    return communities.pending(_nodes(spark, d), _members(spark, d))


@R.frame("J9_without_report", f"WITH {_M} SELECT DISTINCT community FROM m WHERE community % 7 = 0")
def without_report(spark, d):
    return communities.without_report(_members(spark, d).select("community").distinct(), _reports(spark, d))


@R.frame("G26_stale_by_age", f"WITH {_M}, {_R} SELECT community FROM rep WHERE stale OR updated_at < (SELECT max(o_orderdate) FROM orders) - INTERVAL 300 DAY")
def stale_by_age(spark, d):
    now = table(spark, d, "orders").agg(F.max("o_orderdate").alias("now"))
    return communities.stale_by_age(_reports(spark, d).join(F.broadcast(now)), F.col("now"), 300).select("community")


@R.frame("J6_orphan_vectors", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def orphan_vectors(spark, d):
    live = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("node"))
    return communities.pending(table(spark, d, "embeddings"), live, "vec_id").select(F.col("node").alias("vec_id"))


@R.frame("J12_neighbours", f"WITH {_G} SELECT src, dst FROM u WHERE src % 50 = 0")
def neighbours(spark, d):
    return graph.both_ways(_edges(spark, d)).where("src % 50 = 0").select("src", "dst")


@R.frame("A30_neighbour_collect", f"WITH {_G} SELECT src AS node, array_to_string(list_sort(list_distinct(list(dst))), ',') AS others FROM u GROUP BY src")
def neighbour_collect(spark, d):
    return graph.both_ways(_edges(spark, d)).groupBy(F.col("src").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("others"))


@R.frame("J30_types_by_keys", "SELECT p_partkey, p_name, p_type FROM part WHERE p_partkey % 50 = 0")
def types_by_keys(spark, d):
    """Names and types of asked keys: the asked side is a stated set, the entities are scanned once."""
    asked = table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("k"))
    return table(spark, d, "part").join(asked, F.col("p_partkey") == F.col("k")).select("p_partkey", "p_name", "p_type")


@R.frame("J31_neighbourhood", f"WITH {_G}, s AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 50 = 0), one AS (SELECT s.node AS center, u.dst AS other FROM s JOIN u ON u.src = s.node), two AS (SELECT o.center, u.dst AS other FROM one o JOIN u ON u.src = o.other) SELECT center, other, min(h) AS hops FROM (SELECT *, 1 AS h FROM one UNION ALL SELECT *, 2 FROM two) WHERE center <> other GROUP BY 1, 2")
def neighbourhood(spark, d):
    seeds = _nodes(spark, d).where("node % 50 = 0")
    both = graph.both_ways(_edges(spark, d)).select("src", "dst")
    one = both.join(seeds.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("center"), F.col("dst").alias("other"), F.lit(1).alias("h"))
    two = one.select("center", F.col("other").alias("src")).join(both, "src").select("center", F.col("dst").alias("other"), F.lit(2).alias("h"))
    return one.unionByName(two).where("center <> other").groupBy("center", "other").agg(F.min("h").alias("hops"))


@R.frame("J27_subgraph", f"WITH {_G}, {_M}, n AS (SELECT node FROM m WHERE community <= 5) SELECT src, dst FROM g WHERE src IN (SELECT node FROM n) OR dst IN (SELECT node FROM n)")
def subgraph(spark, d):
    m = _members(spark, d)
    return communities.subgraph(m, _edges(spark, d), m.where("community <= 5").select("community")).select("src", "dst")


@R.frame("J27_subgraph_cap", f"WITH {_G}, {_M}, n AS (SELECT node FROM m WHERE community <= 25) SELECT src, dst, weight FROM g WHERE src IN (SELECT node FROM n) OR dst IN (SELECT node FROM n) ORDER BY weight DESC, src, dst LIMIT 100")
def subgraph_cap(spark, d):
    m = _members(spark, d)
    return communities.subgraph(m, _edges(spark, d), m.where("community <= 25").select("community"), 100)


@R.frame("G8_edge_list", f"WITH {_G} SELECT * FROM g")
def edge_list(spark, d):
    return graph.undirected(_edges(spark, d))


@R.frame("G17_local_clusters", f"WITH RECURSIVE {_G}, nodes AS (SELECT p_partkey AS n FROM part WHERE p_size <= 25), e AS (SELECT src, dst FROM u WHERE src IN (SELECT n FROM nodes) AND dst IN (SELECT n FROM nodes)), {_ROOTS} SELECT node, component AS community FROM c")
def local_clusters(spark, d):
    return communities.local_clusters(_edges(spark, d), table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("node")))


@R.frame("G3_component_modularity", f"WITH RECURSIVE {_G}, nodes AS (SELECT DISTINCT src AS n FROM u), e AS (SELECT src, dst FROM u), {_ROOTS}, k AS (SELECT count(*) AS m FROM g), x AS (SELECT c.component, count(*) AS inner_edges FROM g JOIN c ON c.node = g.src GROUP BY 1) SELECT round(sum(inner_edges / m - (inner_edges / m) * (inner_edges / m)), 9) AS modularity FROM x, k")
def component_modularity(spark, d):
    """No edge leaves a component, so its degree sum is twice its edges."""
    e = tables.written(_edges(spark, d).withColumn("weight", F.lit(1.0)))
    return graph.modularity(e, graph.components(e)).select(F.round("modularity", 9).alias("modularity"))


@R.frame("G12_partition_modularity", f"WITH {_G}, p AS (SELECT p_partkey AS node, p_size AS grp FROM part), t AS (SELECT sum(weight) AS m FROM g), i AS (SELECT a.grp, sum(weight) AS w FROM g JOIN p a ON a.node = src JOIN p b ON b.node = dst WHERE a.grp = b.grp GROUP BY 1), s AS (SELECT p.grp, sum(weight) AS tot FROM u JOIN p ON p.node = u.src GROUP BY 1) SELECT round(sum(coalesce(i.w, 0) / m - (tot / (2 * m)) * (tot / (2 * m))), 9) AS modularity FROM s LEFT JOIN i USING (grp), t")
def partition_modularity(spark, d):
    groups = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("component"))
    return graph.modularity(_edges(spark, d), groups).select(F.round("modularity", 9).alias("modularity"))


@R.frame("A23_high_degree", f"WITH {_G}, t AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY 1 ORDER BY degree DESC, node LIMIT 100) SELECT * FROM t WHERE degree >= 3")
def high_degree(spark, d):
    n = graph.both_ways(_edges(spark, d)).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return n.orderBy(F.desc("degree"), "node").limit(100).where("degree >= 3")


@R.frame("K6_component_sort", f"WITH RECURSIVE {_G}, nodes AS (SELECT DISTINCT src AS n FROM u), e AS (SELECT src, dst FROM u), {_ROOTS} SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS place FROM c GROUP BY component ORDER BY place LIMIT 20")
def component_sort(spark, d):
    sizes = graph.components(_edges(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.orderBy(F.desc("size"), "component").limit(20)  # the report's length; what is numbered are these rows
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "component")))


@R.frame("A28_health_inputs", f"WITH {_M}, {_R}, c AS (SELECT community, count(*) AS n FROM m GROUP BY 1) SELECT count(*) AS total, round(avg(n), 9) AS mean, count(rep.community) AS reported, count(CASE WHEN rep.stale THEN 1 END) AS stale FROM c LEFT JOIN rep USING (community)")
def health_inputs(spark, d):
    c = health.build_communities(_members(spark, d))
    both = c.join(_reports(spark, d).select("community", "stale", F.lit(True).alias("has")), "community", "left")
    return both.agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("entity_count"), 9).alias("mean"), F.count("has").alias("reported"), F.count(F.when(F.col("stale"), 1)).alias("stale"))


@R.frame("G7_recommendations", f"WITH {_G}, t AS (SELECT count(*) AS n, (SELECT count(DISTINCT src) FROM u) AS linked, (SELECT count(*) FROM g) AS edges FROM part) SELECT CASE WHEN (n - linked) / n > 0.1 THEN 'orphans,' ELSE '' END || CASE WHEN 2.0 * edges / n < 1.5 THEN 'sparse' ELSE '' END AS advice FROM t")
def recommendations(spark, d):
    n = _nodes(spark, d).agg(F.count(F.lit(1)).alias("n"))
    e = _edges(spark, d)
    linked = graph.both_ways(e).agg(F.countDistinct("src").alias("linked"), F.count(F.lit(1)).alias("ends"))
    one = n.join(F.broadcast(linked))  # two single rows
    return one.select(F.concat_ws(",", health.advice("n", F.col("n") - F.col("linked"), F.lit(1), F.col("ends") / F.col("n"))).alias("advice"))


@R.frame("G11_orphan_community", f"WITH {_G} SELECT 'orphans' AS community, -1 AS level, count(*) AS entity_count, CAST(0 AS DOUBLE) AS rank FROM part WHERE p_partkey NOT IN (SELECT src FROM u)")
def orphan_community(spark, d):
    return communities.orphan_community(_nodes(spark, d), _edges(spark, d))


@R.frame("G10_hierarchy")
def build_hierarchy(spark, d):
    """Communities of the part graph with level, parent, size and rank, from their detection."""
    return leiden.build_hierarchy(leiden.hierarchy(_edges(spark, d)))


@R.frame("G13_rebuild")
def rebuild(spark, d):
    """All communities anew: the stored ones go, those found take their place in one commit, nodes without an edge share one community."""
    return communities.rebuild(keyed.KeyedTable(spark, tables.shared_dir(spark), ["level", "community"], "level int, community bigint, parent bigint, entity_count bigint, rank double"), _nodes(spark, d), _edges(spark, d))


@R.frame("G13_component_rebuild", f"WITH RECURSIVE {_G}, nodes AS (SELECT p_partkey AS n FROM part), e AS (SELECT src, dst FROM u), {_ROOTS} SELECT component AS community, 0 AS level, count(*) AS entity_count, least(count(*) / 10.0, 10.0) AS rank FROM c GROUP BY component")
def component_rebuild(spark, d):
    """All communities anew, from the whole graph's components; the old ones are not read."""
    found = communities.local_clusters(_edges(spark, d), _nodes(spark, d))
    return health.build_communities(found).drop("parent")


_INCREMENT = f"""WITH RECURSIVE {_G}, {_M}, w AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 10 = 0), near AS (SELECT node FROM w UNION SELECT u.dst FROM u JOIN w ON w.node = u.src), aff AS (SELECT DISTINCT community FROM m JOIN near USING (node)),
ins AS (SELECT node FROM m JOIN aff USING (community)), sub AS (SELECT src, dst FROM g WHERE src IN (SELECT node FROM ins) OR dst IN (SELECT node FROM ins) OR (src IN (SELECT node FROM w) AND dst IN (SELECT node FROM w))),
nodes AS (SELECT src AS n FROM sub UNION SELECT dst FROM sub UNION SELECT node FROM w), e AS (SELECT src, dst FROM sub UNION SELECT dst, src FROM sub), {_ROOTS},
o AS (SELECT n AS node, m.community AS before FROM nodes LEFT JOIN m ON m.node = n), v AS (SELECT component, before, count(*) AS k FROM c JOIN o USING (node) WHERE before IS NOT NULL GROUP BY 1, 2),
h AS (SELECT before, component, k FROM (SELECT *, row_number() OVER (PARTITION BY before ORDER BY k DESC, component) AS q FROM v) WHERE q = 1), nm AS (SELECT component, before AS name FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY k DESC, before) AS q FROM h) WHERE q = 1),
a AS (SELECT o.node, CAST(o.before AS VARCHAR) AS before, coalesce(CAST(nm.name AS VARCHAR), 'new:' || c.component) AS after FROM o JOIN c USING (node) LEFT JOIN nm USING (component)),
ch AS (SELECT *, CASE WHEN before IS NULL THEN 'assigned' ELSE 'moved' END AS change FROM a WHERE before IS DISTINCT FROM after)"""


def _changes(spark, d):
    waiting = communities.pending(_nodes(spark, d), _members(spark, d))
    return communities.incremental_update(_members(spark, d), tables.written(_edges(spark, d)), waiting)


@R.frame("G16_incremental_update", f"{_INCREMENT} SELECT * FROM ch")
def incremental_update(spark, d):
    return _changes(spark, d)


@R.frame("U7_update_summary", f"{_INCREMENT} SELECT change, count(*) AS nodes, count(DISTINCT after) AS communities FROM ch GROUP BY change")
def update_summary(spark, d):
    return _changes(spark, d).groupBy("change").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("after").alias("communities"))


@R.frame("G19_stale_marking", f"{_INCREMENT}, {_R}, now AS (SELECT coalesce(ch.after, CAST(m.community AS VARCHAR)) AS community, count(*) AS present FROM m FULL JOIN ch ON ch.node = m.node GROUP BY 1), mv AS (SELECT community, sum(k) AS k FROM (SELECT before AS community, -1 AS k FROM ch UNION ALL SELECT after, 1 FROM ch) WHERE community IS NOT NULL GROUP BY 1) SELECT CAST(rep.community AS VARCHAR) AS community, rep.stale OR coalesce(abs(mv.k) > 0.1 * now.present, FALSE) AS stale FROM rep LEFT JOIN mv ON mv.community = CAST(rep.community AS VARCHAR) LEFT JOIN now ON now.community = CAST(rep.community AS VARCHAR)")
def stale_marking(spark, d):
    return communities.mark_stale(_members(spark, d), tables.written(_changes(spark, d)), _reports(spark, d)).select("community", "stale")


@R.frame("G20_new_communities", f"WITH RECURSIVE {_G}, nodes AS (SELECT p_partkey AS n FROM part WHERE p_partkey % 10 = 0), e AS (SELECT src, dst FROM u WHERE src % 10 = 0 AND dst % 10 = 0), {_ROOTS} SELECT component AS community, count(*) AS entity_count FROM c GROUP BY component")
def new_communities(spark, d):
    return communities.new_communities(communities.pending(_nodes(spark, d), _members(spark, d)), _edges(spark, d)).select("community", "entity_count")


@R.frame("G14_update_trigger", "SELECT count(*) >= 50 AS due FROM part WHERE p_partkey % 10 = 0")
def update_trigger(spark, d):
    n = communities.pending(_nodes(spark, d), _members(spark, d)).agg(F.count(F.lit(1)).alias("n"))
    return n.select(health.update_due("n", F.lit(0), F.lit(0.0), F.lit(0)).alias("due"))


@R.frame("G27_orphan_cleanup", f"WITH {_G} SELECT p_partkey AS node FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) OR p_partkey IN (SELECT src FROM u)")
def orphan_cleanup(spark, d):
    mentions = table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("node"))
    return communities.without_orphans(_nodes(spark, d), mentions, _edges(spark, d))


@R.frame("G27_archive", "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n IS NULL AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY")
def archive(spark, d):
    o = table(spark, d, "orders")
    _, chain = memory.append_chain(o, o.limit(0), "o_orderkey", "o_orderdate", "o_custkey")
    now = o.agg(F.max("o_orderdate").alias("now"))
    return communities.to_archive(o.join(F.broadcast(now)), chain.select(F.col("src").alias("o_orderkey")), F.col("now"), 90, "o_orderkey", "o_orderdate").select("o_orderkey")


_COS = "list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_HITS = f"hits AS (SELECT query, community, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, community) AS place FROM (SELECT q.vec_id AS query, r.vec_id AS community, {_COS} AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0) WHERE score > 0.1) WHERE place <= 5)"


def _hits(spark, d, indexed=False):
    """Every vector is the report of the community of its number."""
    e = table(spark, d, "embeddings")
    reports = e.select(F.col("vec_id").alias("community"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return communities.nearest_reports(reports, asked, reports.select("community", F.lit(0).alias("level")), 0, 0.1, 5, indexed=indexed)


@R.frame("R18_community_vectors", f"WITH {_HITS} SELECT * FROM hits")
def community_vectors(spark, d):
    return _hits(spark, d, indexed=True).withColumn("score", F.round("score", 6))


@R.frame("R17_report_similarity", f"SELECT q.vec_id AS query, count(*) AS similar FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND {_COS} > 0 GROUP BY 1")
def report_similarity(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.similar_counts(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding"), 0.0, query_id="query")


_KEY = "deg AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY 1), ke AS (SELECT * FROM (SELECT m.community, m.node, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY m.community ORDER BY coalesce(degree, 0) DESC, m.node) AS place FROM m LEFT JOIN deg USING (node)) WHERE place <= 3)"


@R.frame("J23_key_entities_of_communities", f"WITH {_G}, {_M}, {_KEY} SELECT * FROM ke")
def key_entities(spark, d):
    return communities.key_entities(_members(spark, d), _edges(spark, d), 3)


@R.frame("J24_cross_links", f"WITH {_G}, {_M} SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, count(*) AS links, sum(weight) AS weight FROM g JOIN m a ON a.node = src JOIN m b ON b.node = dst WHERE a.community <> b.community GROUP BY 1, 2")
def cross_links(spark, d):
    return communities.cross_links(_members(spark, d), _edges(spark, d))


_GLOBAL = f"""WITH {_G}, {_M}, {_KEY}, {_HITS}, cl AS (SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, sum(weight) AS weight FROM g JOIN m a ON a.node = src JOIN m b ON b.node = dst WHERE a.community <> b.community GROUP BY 1, 2),
every AS (SELECT query, 'communities' AS section, CAST(community AS VARCHAR) AS item, place AS s, 0.0 AS t FROM hits UNION ALL SELECT DISTINCT query, 'entities', CAST(node AS VARCHAR), 0, CAST(-degree AS DOUBLE) FROM hits JOIN ke USING (community)
UNION ALL SELECT x.query, 'links', cl.a || ' - ' || cl.b, 0, -weight FROM cl JOIN hits x ON x.community = cl.a JOIN hits y ON y.community = cl.b AND y.query = x.query), n AS (SELECT query, section, item, row_number() OVER (PARTITION BY query, section ORDER BY s, t, item) AS place FROM every), ctx AS (SELECT * FROM n WHERE section <> 'links' OR place <= 4)"""


def _global(spark, d):
    return communities.global_context(_hits(spark, d), _members(spark, d), _edges(spark, d), 3, 4)


@R.frame("R22_global_context", f"{_GLOBAL} SELECT * FROM ctx")
def global_context(spark, d):
    return _global(spark, d)


@R.frame("R24_global_sections", f"{_GLOBAL} SELECT query, section, count(*) AS items FROM ctx GROUP BY 1, 2")
def global_sections(spark, d):
    return _global(spark, d).groupBy("query", "section").agg(F.count(F.lit(1)).alias("items"))


_MAP = f"WITH {_G}, {_M}, {_KEY}, {_HITS}, mc AS (SELECT query, h.community, '## part size ' || h.community || chr(10) || coalesce(names, '') AS context FROM hits h LEFT JOIN (SELECT community, string_agg(CAST(node AS VARCHAR), ', ' ORDER BY place) AS names FROM ke GROUP BY 1) k ON k.community = h.community)"


def _contexts(spark, d):
    titles = table(spark, d, "part").select(F.col("p_size").cast("long").alias("community"), F.concat(F.lit("part size "), F.col("p_size").cast("string")).alias("title")).distinct()
    whole = table(spark, d, "embeddings").select(F.col("vec_id").alias("community"), F.concat(F.lit("part size "), F.col("vec_id").cast("string")).alias("title"))
    return communities.map_contexts(_hits(spark, d), _members(spark, d), _edges(spark, d), whole.unionByName(titles).distinct(), 3)


@R.frame("R23_map_contexts", f"{_MAP} SELECT * FROM mc")
def map_contexts(spark, d):
    return _contexts(spark, d)


@R.frame("R26_global_search", f"{_MAP} SELECT query, count(*) AS answers, round(0.5 + CASE WHEN count(*) >= 3 THEN 0.1 ELSE 0 END + CASE WHEN sum(length(context)) > 500 THEN 0.2 WHEN sum(length(context)) > 200 THEN 0.1 ELSE 0 END + 0.1, 6) AS confidence FROM mc GROUP BY query")
def global_search(spark, d):
    """A map answer stands for each context (a caller's model writes it); the reduced answer's confidence."""
    n = communities.reduce_answers(_contexts(spark, d), "context")
    return n.select("query", "answers", F.round(context.global_confidence("answers", "chars", "empty"), 6).alias("confidence"))


@R.frame("R27_global_simple", f"{_MAP} SELECT query, round(0.4 + CASE WHEN count(*) >= 3 THEN 0.2 ELSE 0.1 END + CASE WHEN sum(length(context) // 4) > 1000 THEN 0.2 ELSE 0 END, 6) AS confidence FROM mc GROUP BY query")
def global_simple(spark, d):
    n = _contexts(spark, d).groupBy("query").agg(F.count(F.lit(1)).alias("communities"), F.sum(F.floor(F.length("context") / 4)).alias("tokens"))
    return n.select("query", F.round(context.simple_confidence("communities", "tokens"), 6).alias("confidence"))


@R.frame("R28_follow_up_search", f"WITH {_HITS}, p AS (SELECT q.vec_id AS query, count(h.community) AS n FROM embeddings q LEFT JOIN hits h ON h.query = q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1) SELECT query, CASE WHEN n = 0 THEN 0 WHEN 0.3 + n * 0.05 >= 0.7 THEN 0 WHEN greatest(0.3 + n * 0.05, (query % 100) / 100.0) >= 0.7 THEN 1 ELSE 2 END AS asked, CASE WHEN n = 0 THEN 'local' ELSE 'follow_up' END AS mode FROM p")
def follow_up_search(spark, d):
    """Two follow-up questions for each query; their answers' confidence is by rule here, a model's elsewhere."""
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"))
    n = asked.join(_hits(spark, d).groupBy("query").agg(F.count(F.lit(1)).alias("communities")), "query", "left").withColumn("communities", F.coalesce("communities", F.lit(0)))
    primer = n.withColumn("confidence", 0.3 + F.col("communities") * 0.05)
    questions = asked.select("query", F.explode(F.array(F.lit(1), F.lit(2))).alias("place")).withColumn("question", F.concat_ws(":", "query", "place"))
    answers = questions.select("question", F.when(F.col("place") == 1, (F.col("query") % 100) / 100.0).otherwise(0.5).alias("confidence"))
    return communities.follow_up(primer, questions, answers).select("query", "asked", "mode")


@R.frame("G24_report_inputs", f"WITH {_G}, {_M}, {_KEY} SELECT community, names AS nodes, coalesce(links, 0) AS links FROM (SELECT community, string_agg(CAST(node AS VARCHAR), ',' ORDER BY place) AS names FROM ke GROUP BY 1) LEFT JOIN (SELECT a.community, least(count(*), 2) AS links FROM g JOIN m a ON a.node = src JOIN m b ON b.node = dst WHERE a.community = b.community GROUP BY 1) USING (community)")
def report_inputs(spark, d):
    return communities.report_inputs(_members(spark, d), _edges(spark, d), 3, 2).select("community", F.array_join("nodes", ",").alias("nodes"), "links")


@R.frame("R19_text_fallback", "WITH a AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda w: length(w) >= 12) AS l FROM benchmark WHERE text IS NOT NULL), t AS (SELECT item_id, list_filter(l, lambda w, i: list_position(l, w) = i)[1:3] AS ws FROM a), n AS (SELECT item_id, unnest(ws) AS w FROM t) SELECT item_id, count(DISTINCT doc_id) AS found FROM n JOIN (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents WHERE text IS NOT NULL) x USING (w) GROUP BY 1")
def text_fallback(spark, d):
    """Documents that hold one of the first three long words of a query, by a join on words."""
    words = F.slice(F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) >= 12)), 1, 3)
    asked = table(spark, d, "benchmark").where("text IS NOT NULL").select("item_id", F.explode(words).alias("w"))
    held = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    return held.join(asked.select("w").distinct(), "w", "left_semi").join(asked, "w").groupBy("item_id").agg(F.countDistinct("doc_id").alias("found"))


@R.frame("W7_skipping_budget")
def skipping_budget(spark, d):
    """Turns of a conversation in order, those that do not fit in 100 tokens skipped and the rest tried on."""
    c = table(spark, d, "conversations")
    return context.fit_budget(c.withColumn("tokens", F.floor(F.length("text") / 4)), 100, "conv_id", "turn", "tokens")


@R.frame("K7_post_cuts", "SELECT conv_id, count(*) AS turns, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (WHERE place <= 3) AS first FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) GROUP BY conv_id")
def post_cuts(spark, d):
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list("turn")).alias("all"))
    return listed.select("conv_id", "turns", F.array_join(F.slice("all", 1, 3), ",").alias("first"))


# Chains of events.

_CHAIN = "chain AS (SELECT event_id AS src, lead(event_id) OVER w AS dst, round((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 3.6e9, 6) AS hours FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_CAUSES = "cause AS (SELECT a.event_id AS src, b.event_id AS dst FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")


def _causes(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("src"), F.col("ts").alias("t0"))
    b = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("dst"), F.col("ts").alias("t1"))
    return a.join(b, "user_id").where("t1 > t0 AND t1 <= t0 + INTERVAL 1 DAY").select("src", "dst")


@R.frame("M1_append_to_chain", f"WITH {_CHAIN} SELECT src, dst, hours FROM chain WHERE dst IS NOT NULL")
def append_to_chain(spark, d):
    """Even events are there; all come again, so that those that are there are left alone."""
    e = _events(spark, d)
    _, edges = memory.append_chain(e.where("event_id % 2 = 0"), e, by="user_id")
    return edges.withColumn("hours", F.round("hours", 6))


@R.frame("M10_fast_path", "SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM events) - (SELECT count(DISTINCT user_id) FROM events) AS chain, (SELECT count(DISTINCT (event_id, event_type)) FROM events WHERE event_id % 2 = 1) AS links, (SELECT count(*) FROM events WHERE event_id % 2 = 1) AS queue")
def fast_path(spark, d):
    e = _events(spark, d)
    got = memory.ingest(e.where("event_id % 2 = 0"), e, e.select("event_id", F.col("event_type").alias("entity")), by="user_id")
    one = None
    for name, df in got.items():
        n = df.agg(F.count(F.lit(1)).alias(name))
        one = n if one is None else one.join(F.broadcast(n))  # single rows
    return one


@R.frame("W6_event_surroundings", "SELECT event_id AS center, o.other, o.step FROM (SELECT event_id, unnest([{'step': -2, 'other': lag(event_id, 2) OVER w}, {'step': -1, 'other': lag(event_id) OVER w}, {'step': 1, 'other': lead(event_id) OVER w}, {'step': 2, 'other': lead(event_id, 2) OVER w}]) AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE o.other IS NOT NULL")
def event_surroundings(spark, d):
    return memory.around(_events(spark, d))


@R.frame("M11_slow_path", "WITH n AS (SELECT event_id, unnest([lag(event_id, 2) OVER w, lag(event_id) OVER w, lead(event_id) OVER w, lead(event_id, 2) OVER w]) AS other FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), j AS (SELECT n.event_id AS src, n.other AS dst, a.event_type AS ta, b.event_type AS tb FROM n JOIN events a ON a.event_id = n.event_id JOIN events b ON b.event_id = n.other WHERE n.event_id % 50 = 0) SELECT src, dst, 'CAUSES' AS type FROM j WHERE ta = 'purchase' AND tb = 'error' OR ta = 'view' AND tb = 'purchase'")
def slow_path(spark, d):
    e = _events(spark, d)
    kind = lambda name: e.select(F.col("event_id").alias(name), F.col("event_type").alias(f"{name}_type"))
    near = memory.around(e).join(kind("center"), "center").join(kind("other"), "other")
    sure = F.when((F.col("center_type") == "purchase") & (F.col("other_type") == "error"), 0.8).when((F.col("center_type") == "view") & (F.col("other_type") == "purchase"), 0.7).otherwise(0.1)
    queue = e.where("event_id % 50 = 0").select(F.col("event_id").alias("event"), F.col("ts").alias("at"))
    return memory.consolidate(queue, near, sure, F.lit("CAUSES")).select("src", "dst", "type")


@R.frame("M12_events_from_rows", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN coalesce(source, '') <> '' AND coalesce(text, '') <> '' THEN source || chr(10) || chr(10) || text ELSE coalesce(source, '') || coalesce(text, '') END AS content, coalesce(lang, '') AS category FROM documents")
def events_from_rows(spark, d):
    docs = table(spark, d, "documents").withColumn("at", F.lit(None).cast("timestamp"))
    return memory.to_events(docs, "doc_id", "source", "text", "at", F.current_timestamp(), {"category": "lang", "title": "source"}).select("id", "content", F.coalesce(F.col("attributes")["category"], F.lit("")).alias("category"))


@R.frame("M8_anchors", "WITH q AS (SELECT conv_id AS query, CASE WHEN conv_id % 2 = 0 THEN 'why' ELSE 'when' END AS intent FROM conversations GROUP BY 1), f AS (SELECT event_id AS node, row_number() OVER (ORDER BY ts, event_id) AS r FROM events) SELECT query, intent, node FROM q JOIN f ON r <= CASE WHEN intent = 'why' THEN 5 ELSE 3 END")
def anchors(spark, d):
    asked = table(spark, d, "conversations").select(F.col("conv_id").alias("query")).distinct().withColumn("intent", F.when(F.col("query") % 2 == 0, "why").otherwise("when"))
    return memory.anchors(_events(spark, d), asked)


@R.frame("M9_neighbours_by_intent", f"WITH {_CHAIN}, {_CAUSES}, q AS (SELECT event_id AS event, event_id % 100 = 0 AS why FROM events WHERE event_id % 50 = 0), t AS (SELECT src, dst FROM chain WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM chain WHERE dst IS NOT NULL), c AS (SELECT src, dst FROM cause UNION ALL SELECT dst, src FROM cause) SELECT DISTINCT event, dst AS node, 'temporal' AS kind FROM q JOIN t ON t.src = event UNION SELECT event, dst, 'causal' FROM q JOIN c ON c.src = event WHERE why")
def neighbours_by_intent(spark, d):
    e = _events(spark, d)
    asked = e.where("event_id % 50 = 0").select(F.col("event_id").alias("event"), F.when(F.col("event_id") % 100 == 0, "why").otherwise("when").alias("intent"))
    _, chain = memory.append_chain(e, e.limit(0), by="user_id")
    return memory.neighbours_by_intent(asked, chain, _causes(spark, d))


_TIMELINE = "SELECT entity, string_agg('[' || strftime(t0, '%Y-%m-%d %H:%M:%S') || '] ' || text, '; ' ORDER BY r) FILTER (WHERE r <= 10) AS facts, count(*) AS count, least(1.0, count(*) / 5.0) AS confidence FROM (SELECT user_id AS entity, ts AS t0, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS r FROM events) GROUP BY entity"


def _mentions(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("ts").alias("at"), F.col("event_type").alias("text"))


@R.frame("A33_timeline", _TIMELINE)
def timeline(spark, d):
    return memory.timeline(_mentions(spark, d)).withColumn("facts", F.array_join("facts", "; "))


@R.frame("M13_aggregate_dispatch", "SELECT user_id AS entity, count(*) AS count, least(1.0, count(*) / 10.0) AS confidence FROM events GROUP BY 1")
def aggregate_dispatch(spark, d):
    return memory.entity_aggregate(_mentions(spark, d), "count")


@R.frame("M16_temporal_search", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY ORDER BY ts, event_id LIMIT 100")
def temporal_search(spark, d):
    return memory.temporal_search(table(spark, d, "events"), 100, 7).select("event_id", "ts")


@R.frame("M17_causal_search", f"WITH RECURSIVE {_CAUSES}, w AS (SELECT event_id AS query, event_id AS node, 0 AS depth FROM events WHERE event_id % 50 = 0 AND event_type = 'error' UNION SELECT w.query, cause.src, w.depth + 1 FROM w JOIN cause ON cause.dst = w.node WHERE w.depth < 3) SELECT query, node, min(depth) AS distance FROM w WHERE depth > 0 GROUP BY 1, 2")
def causal_search(spark, d):
    asked = table(spark, d, "events").where("event_id % 50 = 0 AND event_type = 'error'").select(F.col("event_id").alias("event"))
    found = memory.causal_chain(_causes(spark, d).withColumn("type", F.lit("CAUSES")), asked, 3)
    return found.select(F.col("event").alias("query"), "node", "distance")


# Rankings.


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_KNN = "s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)"


@R.frame("J2_batch_nearest", f"WITH {_KNN} SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity >= 0.2) WHERE rank <= 5")
def batch_nearest(spark, d):
    return retrieval.knn(*_vectors(spark, d), 5, 0.2).select("query_id", "id", "rank")


@R.frame("K2_top_similarity", f"WITH {_KNN} SELECT id, round(similarity, 6) AS similarity FROM s WHERE query_id = 0 ORDER BY s.similarity DESC, id LIMIT 10")
def top_similarity(spark, d):
    e, q = _vectors(spark, d)
    return retrieval.knn(e, q.where("query_id = 0"), 10).select("id", F.round("similarity", 6).alias("similarity"))


@R.frame("R5_entity_nearest", f"WITH {_KNN} SELECT query_id, count(*) AS close FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity >= 0.3 AND id <> query_id) WHERE rank <= 5 GROUP BY 1")
def entity_nearest(spark, d):
    """Candidates of a resolution: above the threshold, five at most, itself left out."""
    return retrieval.knn(*_vectors(spark, d), 5, 0.3, others=True).groupBy("query_id").agg(F.count(F.lit(1)).alias("close"))


_TWO = f"{_KNN}, v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s), b AS (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY e.vec_id DESC) AS rank FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 50 = 0)"


def _two_lists(spark, d):
    """The ten nearest vectors of a query, and the ten newest of its label."""
    e, q = _vectors(spark, d)
    near = retrieval.knn(e, q, 10).select("query_id", "id", "rank", F.lit("vector").alias("list"))
    newest = retrieval.ranked(e.select("label", F.col("vec_id").alias("id"), F.col("vec_id").alias("score")), ["label"]).where("rank <= 10")
    own = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").join(newest, "label").select("query_id", "id", "rank", F.lit("bm25").alias("list"))
    return near.unionByName(own)


@R.frame("R8_fusion_with_ranks", f"WITH {_TWO} SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.id, b.id) AS id, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score, v.rank AS vector_rank, b.rank AS bm25_rank FROM (SELECT * FROM v WHERE rank <= 10) v FULL JOIN (SELECT * FROM b WHERE rank <= 10) b ON v.query_id = b.query_id AND v.id = b.id")
def fusion_with_ranks(spark, d):
    fused = retrieval.reciprocal_rank_fusion(_two_lists(spark, d), by=("query_id",))
    return fused.select("query_id", "id", F.round("score", 9).alias("score"), F.try_element_at("ranks", F.lit("vector")).alias("vector_rank"), F.try_element_at("ranks", F.lit("bm25")).alias("bm25_rank"))


@R.frame("W2_rank_maps", f"WITH {_TWO} SELECT query_id, id, 'vector' AS list, rank FROM v WHERE rank <= 10 UNION ALL SELECT query_id, id, 'bm25', rank FROM b WHERE rank <= 10")
def rank_maps(spark, d):
    return _two_lists(spark, d).select("query_id", "id", "list", "rank")


@R.frame("R15_apply_decay", "SELECT event_id, round(value * CASE WHEN user_id % 5 = 0 THEN 1 ELSE exp(-ln(2) / 30 * (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 8.64e10) END, 6) AS score FROM events")
def apply_decay(spark, d):
    e = table(spark, d, "events")
    aged = e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).withColumn("age", F.when(F.col("user_id") % 5 != 0, C.age_days("ts", F.col("now"))))
    return retrieval.with_decay(aged, "age", 30.0, "value").select("event_id", F.round("value", 6).alias("score"))


@R.frame("X26_age_in_days", "SELECT event_id, round((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 8.64e10, 6) AS age FROM events")
def age_in_days(spark, d):
    e = table(spark, d, "events")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_id", F.round(C.age_days("ts", F.col("now")), 6).alias("age"))


@R.frame("A7_dynamic_groups", "SELECT 'event_type' AS by, event_type AS label, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY event_type UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*), round(sum(value), 4) FROM events GROUP BY user_id")
def dynamic_groups(spark, d):
    e = table(spark, d, "events")
    return context.summary_by(e, "event_type").unionByName(context.summary_by(e, "user_id")).withColumn("total", F.round("total", 4))


@R.frame("A12_final_upsert", "SELECT user_id, count(*) AS calls, round(CASE WHEN count(value) > 0 THEN sum(value) / count(value) ELSE 0 END, 6) AS latency FROM events GROUP BY user_id")
def final_upsert(spark, d):
    """Counters of each key, twice: the later flush replaces the earlier."""
    e = table(spark, d, "events")
    flush = lambda df, at: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("latency")).withColumn("at", F.lit(at))
    return tables.upsert(flush(e.where("event_id % 2 = 0"), 0), flush(e, 1), ["user_id"], "at").drop("at")


@R.frame("P22_outbox_replay", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 <> 0 THEN 'done' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'kept' END AS state FROM orders")
def outbox_replay(spark, d):
    """Pending rows are written to the graph's table; those that it holds afterwards are done, the others failed."""
    o = table(spark, d, "orders")
    sent = tables.written(o.where("o_orderstatus = 'P' AND o_orderkey % 7 <> 0").select("o_orderkey"))
    back = o.join(sent.withColumn("there", F.lit(True)), "o_orderkey", "left")
    return back.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", "kept").when(F.col("there"), "done").otherwise("failed").alias("state"))
