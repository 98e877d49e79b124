"""Rules about names, addresses, writers of graphs and small searches, over the driver's tables with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import context, entities, graph, memory, retrieval
from ..sources import tables
from .registry import Registry, table
from .text import LISTED

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

# Names by size and by key: each meets each, so every rule has its cases.
_A = ("OpenAI Inc", "谷歌", "AI", "Beijing", "张伟先生", "华北电力集团", "江苏省", "Acme (US)", "acme", "Blue Ring")
_B = ("OpenAI", "Google", "人工智能", "北京", "张伟", "华北电力", "江苏", "Acme", "ACME", "blue ring")
_KIND = ("组织机构", "组织机构", "其他", "地点", "人物", "组织机构", "地点", "组织机构", "组织机构", "其他")
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_NAMED = f"n AS (SELECT p_partkey AS k, {_list(_A)}[p_size % 10 + 1] AS a, {_list(_B)}[p_partkey % 10 + 1] AS b, {_list(_KIND)}[p_size % 10 + 1] AS kind FROM part)"
_BARE = "trim(regexp_replace({0}, '\\s*\\([^)]+\\)$', ''))"


def _named(spark, d):
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    size, key = F.col("p_size") % 10, F.col("p_partkey") % 10
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), pick(_A, size).alias("a"), pick(_B, key).alias("b"), pick(_KIND, size).alias("kind"))


@R.frame("D15_plain_rules", f"WITH {_NAMED} SELECT k, CASE WHEN a = b THEN 'exact' WHEN lower(a) = lower(b) THEN 'case' WHEN {_BARE.format('a')} = {_BARE.format('b')} THEN 'bracket' END AS rule FROM n WHERE a = b OR lower(a) = lower(b) OR {_BARE.format('a')} = {_BARE.format('b')}")
def plain_rules(spark, d):
    m = _named(spark, d).withColumn("rule", entities.match_rule("a", "b")["rule"])
    return m.where(F.col("rule").isin("exact", "case", "bracket")).select("k", "rule")


@R.frame("D16_table_rules", f"WITH {_NAMED}, t(a, b, rule, confidence) AS (VALUES ('OpenAI Inc', 'OpenAI', 'alias', 0.95), ('谷歌', 'Google', 'alias', 0.95), ('AI', '人工智能', 'abbreviation', 0.9), ('Beijing', '北京', 'translation', 0.9)) SELECT k, rule, CAST(confidence AS DOUBLE) AS confidence FROM n JOIN t USING (a, b)")
def table_rules(spark, d):
    m = _named(spark, d).withColumn("m", entities.match_rule("a", "b"))
    return m.where(F.col("m.rule").isin("alias", "abbreviation", "translation")).select("k", "m.rule", "m.confidence")


@R.frame("D17_variant_rules", f"WITH {_NAMED} SELECT k, CASE kind WHEN '人物' THEN 'person' WHEN '组织机构' THEN 'organisation' ELSE 'place' END AS rule FROM n WHERE (a, b) IN (SELECT (x, y) FROM (VALUES ('张伟先生', '张伟'), ('华北电力集团', '华北电力'), ('江苏省', '江苏')) v(x, y))")
def variant_rules(spark, d):
    m = _named(spark, d).withColumn("rule", entities.match_rule("a", "b", "kind")["rule"])
    return m.where(F.col("rule").isin("person", "organisation", "place")).select("k", "rule")


@R.frame("D18_merge_gate", f"WITH {_NAMED} SELECT k FROM n WHERE (a, b) IN (SELECT (x, y) FROM (VALUES ('OpenAI Inc', 'OpenAI'), ('谷歌', 'Google'), ('AI', '人工智能'), ('Beijing', '北京'), ('Acme (US)', 'Acme'), ('acme', 'Acme'), ('acme', 'ACME'), ('Blue Ring', 'blue ring')) v(x, y))")
def merge_gate(spark, d):
    """Pairs that a rule merges: confidence of .9 or more; variants of a kind never do."""
    return _named(spark, d).where(entities.match_rule("a", "b", "kind")["confidence"] >= entities.MERGE_FROM).select("k")


@R.frame("J34_alias_map", f"WITH {_NAMED} SELECT k, CASE a WHEN 'OpenAI Inc' THEN 'OpenAI' WHEN '谷歌' THEN 'Google' WHEN 'AI' THEN '人工智能' WHEN 'Beijing' THEN '北京' ELSE a END AS canonical FROM n")
def alias_map(spark, d):
    return _named(spark, d).select("k", entities.canonical("a").alias("canonical"))


_KNOWN = "kn AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 2 = 0), al AS (SELECT p_brand AS alias, min(p_name) AS name FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)"


def _known(spark, d):
    even = table(spark, d, "part").where("p_partkey % 2 = 0")
    brand = even.groupBy("p_brand").agg(F.min("p_name").alias("name")).groupBy("name").agg(F.array_sort(F.collect_list("p_brand")).alias("aliases"))
    every = even.select(F.col("p_name").alias("name")).distinct().join(brand, "name", "left")
    return every.select("name", F.lit("其他").alias("kind"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.lit(None).cast("string").alias("description"))


def _asked(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_name").alias("name")).unionByName(p.select(F.col("p_brand").alias("name"))).unionByName(p.select(F.col("p_type").alias("name"))).distinct().withColumn("kind", F.lit("其他"))


_ASKED = "q AS (SELECT p_name AS name FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part)"


@R.frame("D23_pre_resolve", f"WITH {_KNOWN}, {_ASKED} SELECT q.name, coalesce(kn.name, al.name) AS entity, CASE WHEN kn.name IS NOT NULL THEN 'raw' WHEN al.name IS NOT NULL THEN 'alias' END AS how FROM q LEFT JOIN kn ON kn.name = q.name LEFT JOIN al ON al.alias = q.name")
def pre_resolve(spark, d):
    got = entities.resolve(_asked(spark, d), _known(spark, d), composed=True)
    return got.select("name", "entity", F.when(F.col("how") == "normal", "raw").otherwise(F.col("how")).alias("how"))


@R.frame("D22_batch_resolve", f"WITH {_KNOWN}, {_ASKED} SELECT count(*) AS asked, count(CASE WHEN name IN (SELECT name FROM kn) OR name IN (SELECT alias FROM al) THEN 1 END) AS found FROM q")
def batch_resolve(spark, d):
    return entities.resolve(_asked(spark, d), _known(spark, d), composed=True).agg(F.count(F.lit(1)).alias("asked"), F.count("entity").alias("found"))


@R.frame("D13_candidates", "WITH s AS (SELECT q.vec_id AS name, e.vec_id AS known, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) SELECT name, known FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, known) AS place FROM s WHERE similarity >= 0.25) WHERE place <= 10")
def candidates(spark, d):
    e = table(spark, d, "embeddings")
    near = retrieval.knn(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, 0.25, others=True)
    return near.select(F.col("query_id").alias("name"), F.col("id").alias("known"))


@R.frame("D24_entity_merge", f"WITH {_KNOWN}, {_ASKED} SELECT name FROM kn UNION SELECT name FROM q WHERE name NOT IN (SELECT alias FROM al)")
def entity_merge(spark, d):
    known = _known(spark, d)
    return entities.merge_entities(known, entities.resolve(_asked(spark, d), known, composed=True)).select("name").distinct()


@R.frame("X43_alias_append", "SELECT p_name, array_to_string(list_sort(list_distinct(list_append(list(DISTINCT p_brand), 'Brand#1'))), ',') AS aliases FROM part GROUP BY p_name")
def alias_append(spark, d):
    names = table(spark, d, "part").groupBy("p_name").agg(F.collect_set("p_brand").alias("aliases"))
    return names.select("p_name", F.array_join(F.array_sort(F.array_union("aliases", F.array(F.lit("Brand#1")))), ",").alias("aliases"))


@R.frame("X44_edge_weight", "SELECT l_partkey, l_suppkey, CAST(round(1 + 0.1 * (count(*) - 1), 6) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2")
def edge_weight(spark, d):
    mentions = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("SUPPLIES").alias("type"))
    return entities.merge_relations(mentions).select(F.col("src").alias("l_partkey"), F.col("dst").alias("l_suppkey"), F.round("weight", 6).alias("weight"))


@R.frame("X45_first_weight", "SELECT l_partkey, l_suppkey, min_by(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS weight FROM lineitem GROUP BY 1, 2")
def first_weight(spark, d):
    """The first write of an edge stays; later ones change nothing."""
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min_by("l_quantity", F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("weight"))


_MERGES = "m AS (SELECT l_orderkey AS id, max(l_partkey) AS t FROM lineitem GROUP BY 1)"


@R.frame("D10_merge_cycles", f"WITH RECURSIVE {_MERGES}, r AS (SELECT id, t, 1 AS n FROM m UNION SELECT r.id, m.t, r.n + 1 FROM r JOIN m ON m.id = r.t WHERE r.n < 40) SELECT DISTINCT id FROM r WHERE id = t")
def merge_cycles(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_partkey").alias("merged_into"))
    return graph.on_cycles(m)


@R.frame("D7_union_groups", "WITH RECURSIVE e AS (SELECT l_orderkey AS a, max(l_partkey) + 1000000000 AS b FROM lineitem WHERE l_quantity > 49 GROUP BY 1), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node) SELECT root, count(*) AS members FROM (SELECT node, min(root) AS root FROM r GROUP BY 1) GROUP BY root")
def union_groups(spark, d):
    e = table(spark, d, "lineitem").where("l_quantity > 49").groupBy(F.col("l_orderkey").alias("src")).agg((F.max("l_partkey") + 1000000000).alias("dst"))
    return graph.components(e).groupBy(F.col("component").alias("root")).agg(F.count(F.lit(1)).alias("members"))


@R.frame("K8_beam_cut", "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 3")
def beam_cut(spark, d):
    scored = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("value").alias("score"))
    return retrieval.ranked(scored, ["user_id"]).where("rank <= 3").select("user_id", F.col("id").alias("event_id"), F.col("rank").alias("place"))


@R.frame("U2_typed_and_generic", "SELECT l_returnflag AS kind, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 UNION ALL SELECT 'other', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')")
def typed_and_generic(spark, d):
    li = table(spark, d, "lineitem")
    typed = li.where(F.col("l_returnflag").isin("A", "R")).groupBy(F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return typed.unionByName(li.where(~F.col("l_returnflag").isin("A", "R")).agg(F.lit("other").alias("kind"), F.count(F.lit(1)).alias("n")))


@R.frame("U8_word_sets", "WITH w AS (SELECT conv_id, list_distinct(string_split(lower(string_agg(text, ' ' ORDER BY turn)), ' ')) AS a FROM conversations WHERE role = 'user' GROUP BY 1), v AS (SELECT conv_id, list_distinct(string_split(lower(string_agg(text, ' ' ORDER BY turn)), ' ')) AS b FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT conv_id, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS every FROM w JOIN v USING (conv_id)")
def word_sets(spark, d):
    c = table(spark, d, "conversations")
    words = lambda role, name: c.where(F.col("role") == role).groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(F.split(F.lower("text"), " ")))).alias(name))
    both = words("user", "a").join(words("assistant", "b"), "conv_id")
    return both.select("conv_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(F.array_union("a", "b")).cast("long").alias("every"))


@R.frame("X31_week_and_hour", "SELECT event_id, strftime(ts, '%Y%m%d%H') AS hour_key, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week FROM events")
def week_and_hour(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMddHH").alias("hour_key"), F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"))


@R.frame("X33_cosine_to_first", "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 6) AS same FROM embeddings e, embeddings f WHERE f.vec_id = 0")
def cosine_to_first(spark, d):
    e = table(spark, d, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("f"))
    return e.join(F.broadcast(first)).select("vec_id", F.round(C.cosine("embedding", "f"), 6).alias("same"))  # one row


# Addresses with what each check looks for.
_URLS = "u AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN replace(url, '://', '://a.b.c.d.e.f.') WHEN 1 THEN replace(url, '://', '://xn--x.') WHEN 2 THEN replace(url, '://', '://12.a-b-c-d-e-f-g.') WHEN 3 THEN url || '%2541' WHEN 4 THEN url || '/%2e%2e/login-verify-account' WHEN 5 THEN 'https://bit.ly:' || (page_id * 13) || '/x' ELSE url || repeat('x', page_id * 9 % 3000) END AS url FROM pages)"
_HOST = "lower(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), ':\\d*$', ''))"


def _urls(spark, d):
    k, u = F.col("page_id"), F.col("url")
    put = lambda x: F.replace(u, F.lit("://"), F.lit("://" + x))
    odd = F.when(k % 7 == 0, put("a.b.c.d.e.f.")).when(k % 7 == 1, put("xn--x.")).when(k % 7 == 2, put("12.a-b-c-d-e-f-g.")).when(k % 7 == 3, F.concat(u, F.lit("%2541"))).when(k % 7 == 4, F.concat(u, F.lit("/%2e%2e/login-verify-account")))
    odd = odd.when(k % 7 == 5, F.concat(F.lit("https://bit.ly:"), (k * 13).cast("string"), F.lit("/x"))).otherwise(F.concat(u, F.expr("repeat('x', CAST(page_id * 9 % 3000 AS INT))")))
    return table(spark, d, "pages").select("page_id", odd.alias("url"))


def _check(name):
    return lambda spark, d: _urls(spark, d).select("page_id", C.url_checks("url")[name].cast("int").alias("level"))


R.frame("V3_encoding_check", f"WITH {_URLS} SELECT page_id, CASE WHEN contains(url_decode(url), '%') THEN 2 WHEN regexp_matches(lower(url), '%00|%0d|%0a|%2e%2e|%25') THEN 3 ELSE 0 END AS level FROM u")(_check("encoding"))
R.frame("V4_keyword_check", f"WITH {_URLS}, n AS (SELECT page_id, len(list_filter({_list(LISTED)}, lambda w: contains(lower(url_decode(url)), w))) AS n FROM u) SELECT page_id, CASE WHEN n >= 3 THEN 3 WHEN n >= 1 THEN 2 ELSE 0 END AS level FROM n")(_check("words"))
R.frame("V5_domain_check", f"WITH {_URLS}, h AS (SELECT page_id, {_HOST} AS h FROM u), o AS (SELECT page_id, h, CAST(len(string_split(h, '.')) > 5 AS INTEGER) + CAST(len(list_filter(string_split(h, '.'), lambda p: length(p) > 63)) > 0 AS INTEGER) + CAST(length(h) - length(replace(h, '-', '')) > 5 AS INTEGER) + CAST(contains(h, 'xn--') AS INTEGER) + CAST(regexp_matches(string_split(h, '.')[1], '^[0-9]+$') AS INTEGER) AS odd FROM h) SELECT page_id, CASE WHEN h IN ('bit.ly', 'goo.gl', 't.co') THEN 1 WHEN odd >= 2 THEN 3 WHEN odd = 1 THEN 2 ELSE 0 END AS level FROM o")(_check("domain"))
R.frame("V6_port_check", f"WITH {_URLS}, p AS (SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, '^[A-Za-z]+://[^/?#]*:(\\d+)', 1) AS INTEGER), 0) AS p FROM u) SELECT page_id, CASE WHEN p IN (22, 23, 445, 3389, 4444, 5555, 6667) THEN 3 WHEN p > 49151 THEN 2 ELSE 0 END AS level FROM p")(_check("port"))
R.frame("V6_length_check", f"WITH {_URLS} SELECT page_id, CASE WHEN length(url) > 2000 THEN 2 WHEN length(url) > 1000 THEN 1 ELSE 0 END AS level FROM u")(_check("length"))


# Sources and sinks.


@R.frame("S17_json_scan", "SELECT event_id, event_type AS label, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_scan(spark, d):
    """Nodes whose properties are a JSON text, read with a stated schema."""
    return table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint")).select("event_id", F.col("event_type").alias("label"), "p.k")


@R.frame("S26_migrate_graph", "SELECT 'edges' AS name, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'suppliers', count(*) FROM supplier")
def migrate_graph(spark, d):
    """Nodes first, then edges whose both ends are there."""
    target = tables.shared_dir(spark)
    tables.migrate(spark, {n: f"{d}/{t}.parquet" for n, t in (("parts", "part"), ("suppliers", "supplier"))}, target, {"parts": {"p_partkey": "id"}, "suppliers": {"s_suppkey": "id"}})
    parts, suppliers = (spark.read.parquet(f"{target}/{n}") for n in ("parts", "suppliers"))
    e = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    e = e.join(parts.select(F.col("id").alias("l_partkey")), "l_partkey", "left_semi").join(suppliers.select(F.col("id").alias("l_suppkey")), "l_suppkey", "left_semi")
    e.write.parquet(f"{target}/edges")
    size = lambda n: spark.read.parquet(f"{target}/{n}").groupBy().agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
    return size("edges").unionByName(size("parts")).unionByName(size("suppliers"))


@R.frame("S27_index_round_trip", "SELECT count(*) AS postings, count(DISTINCT doc_id) AS documents, count(DISTINCT term) AS terms FROM (SELECT DISTINCT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')) AS term FROM documents WHERE text IS NOT NULL)")
def index_round_trip(spark, d):
    """The postings as a table that is read back."""
    index = tables.written(retrieval.postings(table(spark, d, "documents"), "doc_id", "text"))
    return index.agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("id").alias("documents"), F.countDistinct("term").alias("terms"))


@R.frame("P18_vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS model FROM embeddings")
def vector_upsert(spark, d):
    e = table(spark, d, "embeddings")
    return tables.upsert(e.withColumn("model", F.lit("old")), e.where("vec_id % 3 = 0").withColumn("model", F.lit("new")), ["vec_id"]).select("vec_id", "model")


@R.frame("P19_temporary_keys", "SELECT CASE WHEN vec_id % 2 = 0 THEN 'entity:' || vec_id ELSE 'temp:' || vec_id END AS key FROM embeddings")
def temporary_keys(spark, d):
    """Vectors stored under temporary keys get their entity's key once it has one."""
    stored = table(spark, d, "embeddings").select(F.concat(F.lit("temp:"), F.col("vec_id").cast("string")).alias("key"))
    names = table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.concat(F.lit("temp:"), F.col("vec_id").cast("string")).alias("key"), F.concat(F.lit("entity:"), F.col("vec_id").cast("string")).alias("real"))
    return stored.join(names, "key", "left").select(F.coalesce("real", "key").alias("key"))


@R.frame("F14_name_or_alias_search", "SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), '#12')")
def name_or_alias_search(spark, d):
    known = table(spark, d, "part").groupBy("p_name").agg(F.collect_set("p_brand").alias("aliases"))
    return known.where(F.lower("p_name").contains("ring") | F.exists("aliases", lambda a: F.lower(a).contains("#12"))).select("p_name")


@R.frame("F17_community_search", "SELECT p_size AS community, count(*) AS members FROM part GROUP BY 1 HAVING count(CASE WHEN contains(lower(p_name), 'cold') THEN 1 END) > 0")
def community_search(spark, d):
    """Communities with a member whose name has the words, and their size."""
    p = table(spark, d, "part").groupBy(F.col("p_size").alias("community")).agg(F.count(F.lit(1)).alias("members"), F.count(F.when(F.lower("p_name").contains("cold"), 1)).alias("hits"))
    return p.where("hits > 0").select("community", "members")


@R.frame("J21_articles_by_entities", "SELECT DISTINCT o_orderkey, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 50 = 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def articles_by_entities(spark, d):
    told = table(spark, d, "lineitem").where("l_partkey % 50 = 0").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, d, "orders").join(told, "o_orderkey", "left_semi").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)


@R.frame("J32_one_hop", "SELECT l_partkey AS center, count(DISTINCT l_suppkey) AS others FROM lineitem WHERE l_partkey % 50 = 0 GROUP BY 1")
def one_hop(spark, d):
    e = table(spark, d, "lineitem").where("l_partkey % 50 = 0").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).distinct()
    return graph.degrees(e).where("outgoing > 0").select(F.col("node").alias("center"), F.col("outgoing").alias("others"))


_KNN = "s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0), k AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)"


def _nearest(spark, d, k):
    e = table(spark, d, "embeddings")
    return retrieval.knn(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


@R.frame("R16_vector_only", f"WITH {_KNN} SELECT query_id, id, rank FROM k WHERE rank <= 10")
def vector_only(spark, d):
    """A hybrid search without its lexical list is the vector list."""
    near = _nearest(spark, d, 10)
    texts = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("").alias("text"))
    got = context.hybrid_search(near.limit(0).select("query_id", "id", "rank"), near.select("query_id", "id", "rank"), texts, 10)
    return got.select("query_id", "id", F.col("place").alias("rank"))


@R.frame("R12_rerank", f"WITH {_KNN} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, id) AS INTEGER) AS place FROM k JOIN documents ON doc_id = id WHERE rank <= 10 QUALIFY place <= 5")
def rerank(spark, d):
    """The caller's score (here the text's length, elsewhere a model's) replaces the fused one."""
    near = _nearest(spark, d, 10).select("query_id", "id", "rank")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return context.hybrid_search(near.limit(0), near, texts, 5, rerank=F.length("text").cast("double")).select("query_id", "id", F.col("place").cast("int").alias("place"))


@R.frame("R14_ranks_kept", f"WITH {_KNN}, l AS (SELECT id AS i, query_id AS q, row_number() OVER (PARTITION BY query_id ORDER BY id DESC) AS lr FROM k WHERE rank <= 15) SELECT query_id, id, rank AS vector_rank, lr AS bm25_rank FROM k JOIN l ON q = query_id AND i = id WHERE rank <= 15")
def ranks_kept(spark, d):
    near = _nearest(spark, d, 15)
    other = retrieval.ranked(near.select("query_id", "id", F.col("id").alias("score")), ["query_id"])
    lists = near.select("query_id", "id", "rank", F.lit("vector").alias("list")).unionByName(other.select("query_id", "id", "rank", F.lit("bm25").alias("list")))
    fused = retrieval.reciprocal_rank_fusion(lists, by=("query_id",))
    return fused.select("query_id", "id", F.col("ranks")["vector"].alias("vector_rank"), F.col("ranks")["bm25"].alias("bm25_rank"))


@R.frame("R29_batch_search", f"WITH {_KNN} SELECT query_id, count(*) AS hits, max(id) AS last FROM k WHERE rank <= 7 GROUP BY query_id")
def batch_search(spark, d):
    return _nearest(spark, d, 7).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("id").alias("last"))


@R.frame("R31_intent_classify", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(why|cause[sd]?|because|reason)\\b') THEN 'why' WHEN regexp_matches(lower(text), '\\b(when|date|year|before|after)\\b') THEN 'when' WHEN regexp_matches(lower(text), '\\b(relat\\w+|between|through)\\b') THEN 'multi_hop' WHEN regexp_matches(lower(text), '\\b(who|what|which|where)\\b') THEN 'entity' ELSE 'open' END AS intent FROM conversations")
def intent_classify(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", context.intent("text").alias("intent"))


@R.frame("M15_response_build", "WITH a AS (SELECT user_id AS query, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) SELECT query, count(*) AS sources, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY place) AS kept FROM a WHERE place <= 4 GROUP BY query")
def response_build(spark, d):
    """Found events, best first, packed into a budget with their sources; the answer itself is a model's."""
    hits = retrieval.ranked(table(spark, d, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("id"), F.col("value").alias("score")), ["query"]).where("rank <= 4")
    packed = memory.pack_context(hits.withColumn("text", F.lit("event")), 1000, order="score", item="id")
    return packed.select("query", F.size("kept").cast("long").alias("sources"), F.array_join("kept", ",").alias("kept"))


@R.frame("P8_entity_stage", "SELECT DISTINCT o_orderkey, name FROM (SELECT o_orderkey, o_orderpriority AS name FROM orders UNION ALL SELECT o_orderkey, format('{:,.2f}', o_totalprice) || ' %' FROM orders UNION ALL SELECT l_orderkey, l_returnflag || l_linestatus FROM lineitem) WHERE NOT regexp_matches(name, '^[0-9,.]+\\s*%$')")
def entity_stage(spark, d):
    """Names of both finders, each once, figures left out."""
    o = table(spark, d, "orders")
    found = o.select("o_orderkey", F.col("o_orderpriority").alias("name")).unionByName(o.select("o_orderkey", F.concat(F.format_number("o_totalprice", 2), F.lit(" %")).alias("name")))
    more = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_returnflag", "l_linestatus").alias("name"))
    return found.unionByName(more).where(~entities.is_metric("name")).distinct()


@R.frame("G28_graph_writer", "SELECT (SELECT count(DISTINCT o_orderkey) FROM orders) AS articles, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS entities, (SELECT count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem) AS mentions, (SELECT count(*) FROM orders) - (SELECT count(DISTINCT o_custkey) FROM orders) AS followed")
def graph_writer(spark, d):
    """Articles, entities, mentions and the chain, each merged by its keys; written twice, the tables stay as they are."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    orders, items = 2 * o.count(), 2 * li.count()
    once = lambda df, keys, rows: tables.upsert(df, df, keys, rows=rows).agg(F.count(F.lit(1)).alias("n"))
    articles = once(o.select("o_orderkey"), ["o_orderkey"], orders).withColumnRenamed("n", "articles")
    names = once(li.select("l_partkey").distinct(), ["l_partkey"], items).withColumnRenamed("n", "entities")
    mentions = once(li.select("l_orderkey", "l_partkey"), ["l_orderkey", "l_partkey"], items).withColumnRenamed("n", "mentions")
    chain = memory.append_chain(o, o, "o_orderkey", "o_orderdate", "o_custkey", orders)[1].agg(F.count(F.lit(1)).alias("followed"))
    return articles.join(F.broadcast(names)).join(F.broadcast(mentions)).join(F.broadcast(chain))  # single rows
