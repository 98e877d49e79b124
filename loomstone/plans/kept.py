"""Tables and indexes that are kept: committed writes, a vector index, a posting index, and the retry stream, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, posting_index, retrieval, similar_names, table_functions, vector_index
from ..sources import keyed, tables
from ..streaming import retries, windows
from .registry import Registry, table
from .search import _BM25, _KNN, _queries, _vectors

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL


# Committed writes: three batches by the order's number, the second of them tried twice.


def _batches(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return [o.where(F.col("o_orderkey") % 3 == k) for k in (0, 1, 1, 2)], ("b0", "b1", "b1", "b2")


@R.frame("S18_committed_upsert", "SELECT o_custkey, arg_max(o_orderkey, (o_orderkey % 3, o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def committed_upsert(spark, d):
    """The last batch that has a customer wins, in it the newest order."""
    t = keyed.KeyedTable(spark, tables.shared_dir(spark), ["o_custkey"], "o_custkey bigint, o_orderkey bigint")
    for rows, name in zip(*_batches(spark, d)):
        t.upsert(rows, name, "at")
    return t.read()


_PER = "b AS (SELECT o_custkey, o_orderkey % 3 AS b, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1, 2)"


@R.frame("P13_committed_bulk", f"WITH {_PER}, f AS (SELECT o_custkey, min(b) AS b FROM b WHERE status = 'F' GROUP BY 1), l AS (SELECT o_custkey, max(b) AS b FROM b GROUP BY 1) SELECT o_custkey, o_orderkey, status FROM b JOIN (SELECT l.o_custkey, coalesce(f.b, l.b) AS b FROM l LEFT JOIN f USING (o_custkey)) USING (o_custkey, b)")
def committed_bulk(spark, d):
    """Rows of a final status are not replaced."""
    t = keyed.KeyedTable(spark, tables.shared_dir(spark), ["o_custkey"], "o_custkey bigint, o_orderkey bigint, status string")
    for rows, name in zip(*_batches(spark, d)):
        t.upsert(rows.withColumnRenamed("o_orderstatus", "status"), name, "at", keep_old="status = 'F'")
    return t.read()


@R.frame("P15_committed_insert", "SELECT source, arg_min(doc_id, (doc_id % 3, doc_id)) AS doc_id FROM documents GROUP BY source")
def committed_insert(spark, d):
    """A source that is there keeps its row."""
    t = keyed.KeyedTable(spark, tables.shared_dir(spark), ["source"], "source string, doc_id bigint")
    for k in (0, 1, 1, 2):
        rows = table(spark, d, "documents").where(F.col("doc_id") % 3 == k)
        t.insert(rows.groupBy("source").agg(F.min("doc_id").alias("doc_id")), f"b{k}")
    return t.read()


@R.frame("P22_replayed_outbox", "SELECT user_id, count(*) AS calls FROM events GROUP BY user_id")
def replayed_outbox(spark, d):
    """Counters from four batches, each replayed as if its mark were lost: the ledger lets each in once."""
    t = keyed.KeyedTable(spark, tables.shared_dir(spark), ["user_id"], "user_id bigint, calls bigint")
    e = table(spark, d, "events")
    for k in (0, 1, 0, 2, 3, 2, 1):
        more = e.where(F.col("event_id") % 4 == k).groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"))
        t.commit(more, lambda old, new: old.unionByName(new).groupBy("user_id").agg(F.sum("calls").alias("calls")), f"batch-{k}")
    return t.read()


@R.frame("S24_truncated_sink", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 4 = 0")
def truncated_sink(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    t = keyed.KeyedTable(spark, tables.shared_dir(spark), ["n_nationkey"], n.schema)
    t.upsert(n.where("n_nationkey % 2 = 1"))
    t.replace(n.where("n_nationkey % 2 = 0"))
    t.delete(n.where("n_nationkey % 4 = 2"))
    return t.read()


# Vectors: every embedding is indexed; the queries are those whose id is divisible by 50.


def _vector_index(spark, d):
    e, q = _vectors(spark, d)
    return vector_index.VectorIndex.build(e), q


@R.frame("R4_index_exact", f"{_KNN} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 10")
def index_exact(spark, d):
    index, q = _vector_index(spark, d)
    return index.search(q, 10).withColumn("similarity", F.round("similarity", 6))


@R.frame("R4_index_knn")
def index_knn(spark, d):
    """Ten neighbours from the probed lists only, as many as the recall asks for."""
    index, q = _vector_index(spark, d)
    probes = index.probes_for(q, 10, 0.95)
    return index.search(q, 10, probes)


@R.frame("R4_index_recall", "SELECT count(*) AS queries, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0")
def index_recall(spark, d):
    """Recall at ten of the probed search, measured against the exact one."""
    index, q = _vector_index(spark, d)
    probes = index.probes_for(q, 10, 0.95)
    seen = vector_index.recall(index.search(q, 10, probes), retrieval.knn(*_vectors(spark, d), 10))
    return seen.select("queries", (F.col("recall") >= 0.9).alias("enough"))


@R.frame("J2_index_nearest", f"{_KNN} SELECT query_id, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s WHERE similarity >= 0.2) WHERE rank <= 5")
def index_nearest(spark, d):
    index, q = _vector_index(spark, d)
    return index.search(q, 5, threshold=0.2).select("query_id", "id", "rank")


# Postings: half of the documents come first with other texts, then all as they are, then every seventh is deleted.


def _posting_index(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    index = posting_index.PostingIndex(spark, tables.shared_dir(spark))
    index.add(docs.where("doc_id % 2 = 0").withColumn("text", F.concat_ws(" ", "source", F.substring("text", 1, 200))), batch="early")
    index.add(docs, batch="all")
    index.delete(docs.where("doc_id % 7 = 0"), batch="gone")
    index.add(docs.where("doc_id % 7 = 0"), batch="all")  # a batch that is there already
    return index


_LEFT = _BM25.replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 7 <> 0)")


@R.frame("S29_index_updates", f"{_LEFT} SELECT query_id, id, round(score, 6) AS score FROM b")
def index_updates(spark, d):
    """Scores after updates are those of an index built anew."""
    return _posting_index(spark, d).scores(_queries(spark, d)).withColumn("score", F.round("score", 6))


@R.frame("K3_index_top", f"{_LEFT} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM b) WHERE rank <= 10")
def index_top(spark, d):
    """The ten best by block bounds are the ten best of all."""
    return _posting_index(spark, d).top(_queries(spark, d), 10)


@R.frame("S27_index_compacted", f"{_LEFT}, n AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM l) SELECT docs, words, (SELECT count(*) FROM p) AS postings FROM n")
def index_compacted(spark, d):
    """Documents, words and postings of the index when its segments are merged."""
    index = _posting_index(spark, d)
    index.compact()
    now = index.version()
    return index.postings().agg(F.lit(now["docs"]).cast("bigint").alias("docs"), F.lit(now["words"]).cast("bigint").alias("words"), F.count(F.lit(1)).alias("postings"))


_FAILED = "r AS (SELECT event_id, user_id, CAST(event_id % 5 AS INTEGER) AS attempt, epoch_ms(ts) AS ms FROM events WHERE event_type = 'error')"


@R.frame("Y7_retry_timers", f"WITH {_FAILED} SELECT 'dead' AS kind, user_id AS host, event_id AS item, attempt, CAST(NULL AS BIGINT) AS due FROM r WHERE attempt >= 3 UNION ALL SELECT 'retry', user_id, event_id, attempt + 1, ms + 60000 * CAST(pow(2, attempt) AS BIGINT) FROM r WHERE attempt < 3 AND ms + 60000 * CAST(pow(2, attempt) AS BIGINT) <= (SELECT max(ms) FROM r)")
def retry_timers(spark, d):
    """Errors as failures of their user: what waits comes out when its timer fires, the rest is dead or waits on. All files are one batch: they
    are in no order of time, and a batch that comes after later times would be late."""
    e = windows.event_stream(spark, f"{d}/events.parquet", files_a_batch=1_000_000).where("event_type = 'error'")
    failed = e.select(F.col("event_id").alias("item"), F.col("user_id").alias("host"), (F.col("event_id") % 5).alias("attempt"), F.col("ts").alias("failed_at"), F.lit("failed").alias("outcome"))
    found = windows.run_once(retries.retry_stream(failed), "append")
    return found.select("kind", F.col("host").cast("bigint").alias("host"), F.col("item").cast("bigint").alias("item"), "attempt", F.unix_millis("due").alias("due"))


# Candidates by name, and triangles: joins that do not grow with the square of their input.

_GRAMS = "n AS (SELECT DISTINCT p_name AS x, list_distinct([substring(repeat(chr(2), 2) || lower(p_name) || repeat(chr(3), 2), i, 3) FOR i IN range(1, length(p_name) + 3)]) AS g FROM part WHERE p_name <> '')"


@R.frame("D13_name_links", f"WITH {_GRAMS}, p AS (SELECT a.x AS a, b.x AS b, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS s FROM n a JOIN n b ON a.x < b.x WHERE 100 * least(len(a.g), len(b.g)) >= 60 * greatest(len(a.g), len(b.g))) SELECT a, b, round(i / (s - i), 6) AS similarity FROM p WHERE 100 * i >= 60 * (s - i)")
def name_links(spark, d):
    return similar_names.name_links(table(spark, d, "part"), 60, "p_name").withColumn("similarity", F.round("similarity", 6))


@R.frame("D14_name_candidates", f"WITH {_GRAMS}, q AS (SELECT DISTINCT p_name AS x FROM part WHERE p_partkey % 50 = 0), p AS (SELECT a.x AS asked, b.x AS name, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS s FROM n a JOIN q USING (x), n b) SELECT asked, name, round(i / (s - i), 6) AS similarity FROM p WHERE 100 * i >= 80 * (s - i)")
def name_candidates(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    return similar_names.name_candidates(names, names.where("p_partkey % 50 = 0"), 80).withColumn("similarity", F.round("similarity", 6))


_EDGE = "e AS (SELECT DISTINCT least(o_custkey, o_custkey + 1 + o_orderkey % 40) AS src, greatest(o_custkey, o_custkey + 1 + o_orderkey % 40) AS dst FROM orders)"


@R.frame("J16_graph_triangles", f"WITH {_EDGE} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst")
def graph_triangles(spark, d):
    """Customers and those whose number lies a little above, by their orders' numbers."""
    o = table(spark, d, "orders")
    return graph.triangles(o.select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 40).alias("dst")))


_FIT = "c AS (SELECT CAST(conv_id AS VARCHAR) AS name, CAST(turn AS VARCHAR) AS item, CAST(coalesce(length(text) // 4, 0) AS BIGINT) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations), r AS (SELECT name, item, size, k, CASE WHEN size <= 100 THEN size ELSE 0 END AS used, size <= 100 AS fits FROM c WHERE k = 1 UNION ALL SELECT c.name, c.item, c.size, c.k, CASE WHEN r.used + c.size <= 100 THEN r.used + c.size ELSE r.used END, r.used + c.size <= 100 FROM r JOIN c ON c.name = r.name AND c.k = r.k + 1)"


@R.frame("W7_budget_function", f"WITH RECURSIVE {_FIT} SELECT name, item, size, used FROM r WHERE fits")
def budget_function(spark, d):
    """Turns of a conversation that fit in 100 tokens, by the table function in SQL."""
    table_functions.register(spark)
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("name"), F.col("turn").cast("string").alias("item"), F.floor(F.length("text") / 4).alias("size"), "turn", "text")
    return spark.sql("SELECT * FROM fit_budget(TABLE({c}) PARTITION BY name ORDER BY (turn, text), 100)", c=c)
