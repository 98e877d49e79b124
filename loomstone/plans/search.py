"""BM25, kNN, fusion, decay and diversity over documents and embeddings; graph plans over nations, suppliers, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, leiden, retrieval
from ..sources.tables import written
from .registry import Registry, table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

_TOK = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_POSTINGS = f"""w AS MATERIALIZED (SELECT doc_id, {_TOK} AS words FROM documents), l AS MATERIALIZED (SELECT doc_id, len(words) AS n FROM w),
c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM w) GROUP BY ALL), p AS (SELECT doc_id, term, tf, n FROM c JOIN l USING (doc_id))"""
_BM25 = f"""WITH {_POSTINGS},
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) AS docs, avg(n) AS mean FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT query_id, doc_id AS id, sum(greatest(0, ln(1 + (docs - df + 0.5) / (df + 0.5))) * times * tf / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score FROM p JOIN q USING (term) JOIN f USING (term), s GROUP BY ALL)"""


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@R.frame("R2_bm25_scores", f"{_BM25} SELECT query_id, id, round(score, 6) AS score FROM b")
def bm25_scores(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), _queries(spark, d)).withColumn("score", F.round("score", 6))


@R.frame("R1_bm25_index", f"WITH {_POSTINGS} SELECT doc_id AS id, term, tf, CAST(n AS BIGINT) AS length FROM p")
def bm25_index(spark, d):
    return retrieval.postings(table(spark, d, "documents"), "doc_id", "text")


@R.frame("K3_top_bm25", f"{_BM25} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM b) WHERE rank <= 10")
def bm25_top(spark, d):
    return retrieval.bm25_top(table(spark, d, "documents"), _queries(spark, d), 10)


_KNN = "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)"


@R.frame("R4_vector_knn", f"{_KNN} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 10")
def vector_knn(spark, d):
    e, q = _vectors(spark, d)
    return retrieval.knn(e, q, 10).withColumn("similarity", F.round("similarity", 6))


@R.frame("F18_vector_threshold", f"{_KNN} SELECT query_id, id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.35")
def vector_threshold(spark, d):
    e, q = _vectors(spark, d)
    return retrieval.similarities(e, q, 0.35).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@R.frame("R7_rrf", f"{_BM25}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM b), o AS (SELECT source, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents WHERE source IN (SELECT 'src' || unnest(range(20)))), "
         "t AS (SELECT item_id AS query_id, id, rank FROM benchmark JOIN o ON source = 'src' || item_id % 20 WHERE rank <= 20) SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM r WHERE rank <= 20 UNION ALL SELECT * FROM t) GROUP BY 1, 2")
def rrf(spark, d):
    docs = table(spark, d, "documents")
    lexical = retrieval.bm25_top(docs, _queries(spark, d), 20).select("query_id", "id", "rank", F.lit("bm25").alias("list"))
    # A query's second list depends on its source only: each source is ranked once, and its 20 rows meet all its queries.
    wanted = docs.where(F.col("source").isin([f"src{k}" for k in range(20)])).select("source", F.col("doc_id").alias("id"), F.length("text").cast("double").alias("score"))
    longest = retrieval.ranked(wanted, ["source"]).where("rank <= 20").select("source", "id", "rank")
    asked = _queries(spark, d).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("source"))
    length = asked.join(F.broadcast(longest), "source").select("query_id", "id", "rank", F.lit("length").alias("list"))  # at most 400 rows
    return retrieval.reciprocal_rank_fusion(lexical.unionByName(length), by=("query_id",)).select("query_id", "id", F.round("score", 9).alias("score"))


@R.frame("R11_mmr")
def mmr(spark, d):
    docs = table(spark, d, "documents")
    top = written(retrieval.bm25_top(docs, _queries(spark, d), 20, digits=12).drop("rank"))
    return retrieval.mmr(top.join(docs.select(F.col("doc_id").alias("id"), "text"), "id"), 5, most=20)


_EDGES = "e AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3)"


def similar(spark, d):
    """Edges between vectors of one label with cosine of at least 0.3, written once for all that read them."""
    return written(retrieval.vector_links(table(spark, d, "embeddings"), 0.3, "label"))


@R.frame("D6_vector_clusters", f"WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS node, src AS root FROM u UNION SELECT u.dst, r.root FROM r JOIN u ON u.src = r.node) SELECT node, min(root) AS component FROM r GROUP BY node")
def clusters(spark, d):
    return graph.components(similar(spark, d))


@R.frame("G1_components", f"WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT u.dst, r.root FROM r JOIN u ON u.src = r.node) SELECT node, min(root) AS component FROM r GROUP BY node")
def components(spark, d):
    return graph.components(similar(spark, d), table(spark, d, "embeddings"), "vec_id")


@R.frame("G2_component_sizes", f"WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT u.dst, r.root FROM r JOIN u ON u.src = r.node), c AS (SELECT node, min(root) AS component FROM r GROUP BY node) SELECT component, count(*) AS size FROM c GROUP BY component")
def component_sizes(spark, d):
    return components(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@R.frame("G4_modularity_by_label", f"WITH {_EDGES}, w AS (SELECT src, dst, 1.0 AS weight FROM e), g AS (SELECT vec_id, vec_id % 7 AS g FROM embeddings), x AS (SELECT a.g AS gs, b.g AS gd FROM w JOIN g a ON a.vec_id = src JOIN g b ON b.vec_id = dst), t AS (SELECT g, sum(n) AS tot FROM (SELECT gs AS g, count(*) AS n FROM x GROUP BY gs UNION ALL SELECT gd, count(*) FROM x GROUP BY gd) GROUP BY g) SELECT round((SELECT count(*) FROM x WHERE gs = gd) / (SELECT count(*) FROM x)::DOUBLE - (SELECT sum(tot * tot) FROM t)::DOUBLE / power(2 * (SELECT count(*) FROM x), 2), 9) AS modularity")
def modularity(spark, d):
    edges = similar(spark, d).withColumn("weight", F.lit(1.0))
    groups = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), (F.col("vec_id") % 7).alias("component"))
    return graph.modularity(edges, groups).select(F.round("modularity", 9).alias("modularity"))


@R.frame("G5_degree_table", f"WITH {_EDGES} SELECT vec_id AS node, CAST((SELECT count(*) FROM e WHERE src = vec_id) AS BIGINT) AS outgoing, CAST((SELECT count(*) FROM e WHERE dst = vec_id) AS BIGINT) AS incoming FROM embeddings WHERE vec_id IN (SELECT src FROM e UNION SELECT dst FROM e)")
def degree_table(spark, d):
    return graph.degrees(similar(spark, d))


@R.frame("G9_communities")
def community_detection(spark, d):
    """Communities of the similarity graph, each of more than 10 vectors split again."""
    return leiden.hierarchy(graph.undirected(similar(spark, d)))


@R.frame("J28_center_subgraph", f"WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h AS (SELECT vec_id AS node, 0 AS hops FROM embeddings WHERE vec_id % 50 = 0 UNION SELECT u.dst, h.hops + 1 FROM h JOIN u ON u.src = h.node WHERE h.hops < 3) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM h GROUP BY node")
def center(spark, d):
    return graph.hops(similar(spark, d), table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("node")), 3)


@R.frame("D9_merge_chains", "WITH RECURSIVE m AS (SELECT l_orderkey AS id, max(l_partkey) AS t FROM lineitem GROUP BY 1 HAVING max(l_partkey) < l_orderkey), r AS (SELECT id, t FROM m UNION SELECT r.id, m.t FROM r JOIN m ON m.id = r.t) SELECT id AS item, min(t) AS final FROM r GROUP BY id UNION SELECT t, t FROM m WHERE t NOT IN (SELECT id FROM m)")
def chains(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_partkey").alias("merged_into")).where("merged_into < id")
    return graph.resolve_chains(m)
