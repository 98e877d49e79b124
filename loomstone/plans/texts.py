"""Columns over pages, feeds and untyped values, taking rows in, and schemas, over the driver's tables with their SQL.

pages are crawled addresses, documents feed entries (text as content), conversations bodies and descriptions, events usage records.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import texts as T
from ..operators import entities, intake
from ..sources import tables
from .registry import Registry, table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

_SPA = """(regexp_matches(html, '(?i)<(?:div|section)\\s+id=["''](?:app|root)["''][^>]*>\\s*</(?:div|section)>') OR contains(lower(html), '__next_data__') OR contains(lower(html), '__nuxt__') OR contains(lower(html), 'ng-version') OR contains(lower(html), 'data-reactroot')
OR (len(regexp_extract_all(lower(html), '<script')) > 5 AND length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))) < 200))"""
_SHELLS = "p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<div id=\"app\"> </div>' || html WHEN 1 THEN '<script>__NEXT_DATA__</script>' || html WHEN 2 THEN repeat('<SCRIPT src=x></SCRIPT>', 6) || substr(html, 1, 40) ELSE html END AS html FROM pages)"


@R.frame("S7_needs_browser", f"WITH {_SHELLS} SELECT page_id, {_SPA} AS by_script, {_SPA} OR length(html) < 500 AS browser FROM p")
def needs_browser(spark, d):
    k, h = F.col("page_id") % 4, F.col("html")
    html = F.when(k == 0, F.concat(F.lit('<div id="app"> </div>'), h)).when(k == 1, F.concat(F.lit("<script>__NEXT_DATA__</script>"), h)).when(k == 2, F.concat(F.lit("<SCRIPT src=x></SCRIPT>" * 6), F.substring(h, 1, 40))).otherwise(h)
    return table(spark, d, "pages").withColumn("html", html).select("page_id", T.filled_by_script("html").alias("by_script"), T.needs_browser("html").alias("browser"))


@R.frame("X7_feed_noise", "SELECT doc_id, trim(regexp_replace(CASE doc_id % 3 WHEN 0 THEN text ELSE replace(text, '来源：x 文章原文', '') END, '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM documents WHERE text IS NOT NULL")
def feed_noise(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n近期热门视频你会关注\nmore"))).otherwise(F.concat(F.lit("来源：x\n文章原文"), "text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.strip_feed_noise(text).alias("body"))


_PLAIN = "trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@R.frame("X8_feed_body", f"SELECT conv_id, turn, CASE WHEN role = 'user' AND {_PLAIN.format('text')} <> '' THEN {_PLAIN.format('text')} ELSE 'in short ' || turn END AS body FROM (SELECT *, replace(text, '&', '+') AS t0 FROM conversations) WHERE NOT contains(text, '&')")
def feed_body(spark, d):
    c = table(spark, d, "conversations").where("NOT contains(text, '&')")
    content = F.when(F.col("role") == "user", F.concat(F.lit("<p>"), "text", F.lit("</p>"))).otherwise(F.lit("<br>"))
    return c.select("conv_id", "turn", T.feed_body(content, F.concat(F.lit("<i>in short</i> "), F.col("turn").cast("string"))).alias("body"))


@R.frame("X9_article_address", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'https://mp.weixin.qq.com/s?__biz=Mz' || page_id || '&mid=' || page_id % 7 END AS address FROM pages")
def article_address(spark, d):
    k = F.col("page_id").cast("string")
    content = F.concat(F.lit("<a href='x?__biz=Mz"), k, F.lit("==&amp;"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("mid="), (F.col("page_id") % 7).cast("string"))).otherwise(""), F.lit("'>"))
    return table(spark, d, "pages").select("page_id", T.article_address(content, "url").alias("address"))


@R.frame("X10_body_fallback", "SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) < 200 AND role <> '' THEN role ELSE text END AS body FROM conversations")
def body_fallback(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.body_or_description("text", "role").alias("body"))


@R.frame("X21_quarter_tokens", "SELECT doc_id, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS tokens FROM documents")
def quarter_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.quarter_tokens("text").alias("tokens"))


@R.frame("X22_cut_at_sentence", """WITH n AS (SELECT doc_id, text, len(regexp_extract_all(text, '[一-鿿]')) AS han FROM documents WHERE text IS NOT NULL), t AS (SELECT *, CAST(han + (length(text) - han) // 4 AS BIGINT) AS tokens FROM n),
c AS (SELECT *, CAST(floor(length(text) * 100 / tokens) AS INTEGER) AS size FROM t), x AS (SELECT *, substr(text, 1, size) AS cut FROM c), b AS (SELECT *, length(regexp_extract(cut, '^((?s:.*)[。.\\n])', 1)) AS back FROM x)
SELECT doc_id, CASE WHEN tokens <= 100 THEN text WHEN back - 1 > 0.7 * size THEN substr(cut, 1, back) || '...' ELSE cut || '...' END AS text FROM b""")
def cut_at_sentence(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.truncate_at_sentence("text", 100).alias("text"))


@R.frame("X23_head_and_tail", "WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN len(w) > 50 THEN array_to_string(w[1:35], ' ') || chr(10) || '...[内容截断]...' || chr(10) || array_to_string(w[len(w)-14:], ' ') ELSE text END AS text FROM w")
def head_and_tail(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.head_and_tail("text", 50).alias("text"))


@R.frame("X29_from_epoch", "SELECT event_id, CAST(make_timestamp(CAST(epoch_us(date_trunc('second', ts)) AS BIGINT)) AS TIMESTAMP) AS at FROM events")
def from_epoch(spark, d):
    ms = F.floor(F.unix_micros(F.date_trunc("second", F.col("ts")).cast("timestamp")) / 1000)
    return table(spark, d, "events").select("event_id", T.from_epoch(F.when(F.col("event_id") % 2 == 0, ms).otherwise(ms / 1000)).cast("timestamp_ntz").alias("at"))


@R.frame("X30_parse_iso", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS at FROM orders")
def parse_iso(spark, d):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("no time")).when(F.col("o_orderkey") % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", T.parse_iso(text).cast("timestamp_ntz").alias("at"))


@R.frame("X40_convert_values", "SELECT event_id, epoch_us(ts) // 1000 AS at_ms, make_timestamp(epoch_us(ts) // 1000 * 1000) AS at, CAST(trunc(value) AS BIGINT) AS whole, CAST(user_id AS DOUBLE) AS as_real, lower(event_type) IN ('true', '1', 'yes', 'on', 'view') AS said, CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS spelled, CASE WHEN value > 50 THEN 1 ELSE 0 END AS counted, '[' || user_id || ',' || event_id || ']' AS as_json FROM events")
def convert_values(spark, d):
    e = table(spark, d, "events").withColumn("ms", T.convert("ts", "timestamp", "int64")).withColumn("large", F.col("value") > 50)
    yes = F.when(F.col("event_type") == "view", "Yes").otherwise(F.col("event_type"))
    return e.select("event_id", F.col("ms").alias("at_ms"), T.convert("ms", "epoch", "datetime").cast("timestamp_ntz").alias("at"), T.convert("value", "double", "int").alias("whole"), T.convert("user_id", "int", "double").alias("as_real"), T.convert(yes, "string", "boolean").alias("said"), T.convert("large", "boolean", "string").alias("spelled"), T.convert("large", "boolean", "int").alias("counted"), T.convert(F.array("user_id", "event_id"), "bigint[]", "varchar").alias("as_json"))


_HEX = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('community_' || p_size))"


@R.frame("X4_name_uuid", f"SELECT DISTINCT p_size, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT p_size, {_HEX} AS h FROM part)")
def name_uuid(spark, d):
    return table(spark, d, "part").select("p_size").distinct().select("p_size", T.name_uuid(F.concat(F.lit("community_"), F.col("p_size").cast("string"))).alias("id"))


@R.frame("A11_usage_fields", "WITH f AS (SELECT DISTINCT event_type, user_id % 3 AS k FROM events) SELECT event_type, k, CASE k WHEN 0 THEN 'chat' WHEN 1 THEN 'embedding' ELSE 'chat' END AS kind, CASE k WHEN 2 THEN 'unknown' ELSE 'p1' END AS provider, CASE k WHEN 2 THEN 'chat.p1.m' ELSE 'm' END AS model, event_type AS call_point, 'count' AS metric FROM f")
def usage_fields(spark, d):
    f = table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("k")).distinct()
    label = F.when(F.col("k") == 0, "p1::m").when(F.col("k") == 1, "embedding::p1::m").otherwise("chat.p1.m")
    cut = T.usage_field(F.concat(label, F.lit("::"), "event_type", F.lit("::count")))
    return f.withColumn("f", cut).withColumn("l", T.usage_label(F.col("f.label"))).select("event_type", "k", "l.kind", "l.provider", "l.model", "f.call_point", "f.metric")


@R.frame("P12_row_validation", "SELECT doc_id, CASE WHEN length(trim(coalesce(source, ''))) BETWEEN 1 AND 500 THEN '' ELSE 'title,' END || CASE WHEN length(trim(coalesce(text, ''))) >= 1 THEN '' ELSE 'body,' END || CASE WHEN n_chars / 3000.0 BETWEEN 0 AND 1 THEN '' ELSE 'score,' END AS faults FROM documents WHERE n_chars IS NOT NULL")
def row_validation(spark, d):
    docs = table(spark, d, "documents").where("n_chars IS NOT NULL").withColumn("score", F.col("n_chars") / 3000.0).withColumn("quality", F.lit(None).cast("double"))
    return docs.select("doc_id", F.concat_ws("", F.transform(T.faults(T.article_rules("source", "text", "score", "quality")), lambda x: F.concat(x, F.lit(",")))).alias("faults"))


@R.frame("P14_field_mapping", "SELECT doc_id AS article_id, text AS body, coalesce(lang, 'unknown') AS language, source, n_chars, FALSE AS is_merged FROM documents")
def field_mapping(spark, d):
    return intake.map_fields(table(spark, d, "documents"), {"doc_id": "article_id", "text": "body", "lang": "language"}, {"language": "unknown", "is_merged": False})


@R.frame("X41_property_mapping", "SELECT s_suppkey AS id, s_name AS canonical_name, s_nationkey, coalesce(s_acctbal, 0) AS score, 'ORG' AS type FROM supplier")
def property_mapping(spark, d):
    return intake.map_fields(table(spark, d, "supplier"), {"s_suppkey": "id", "s_name": "canonical_name", "s_acctbal": "score"}, {"score": 0.0, "type": "ORG"})


@R.frame("P5_analysis_defaults", "SELECT d.doc_id, coalesce(CAST(l.quality AS DOUBLE), 0.5) AS quality_score, coalesce(CAST(l.toxic AS DOUBLE), 0.5) AS score FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id")
def analysis_defaults(spark, d):
    given = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality_score"), F.max("toxic").cast("double").alias("score"))
    return intake.map_fields(table(spark, d, "documents").select("doc_id").join(given, "doc_id", "left"), {}, {"quality_score": 0.5, "score": 0.5})


@R.frame("F24_safe_names", "SELECT p_partkey, regexp_matches(replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE ' ' END), '^[A-Za-z_][A-Za-z0-9_]*$') AS as_column, regexp_matches(p_type, '^[A-Z][A-Z0-9_]*$') AS as_edge, FALSE AS as_uuid FROM part")
def safe_names(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.safe_name(name).alias("as_column"), T.safe_name("p_type", "edge").alias("as_edge"), T.safe_name("p_name", "uuid").alias("as_uuid"))


@R.frame("F25_included_sections", "SELECT conv_id, turn, lower(role) IN ('user', 'system') AS asked FROM conversations")
def included_sections(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.included("role", "User, SYSTEM").alias("asked"))


@R.frame("F19_array_containment", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT')")
def array_containment(spark, d):
    """Customers whose collected priorities contain one."""
    had = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("all"))
    return had.where(F.array_contains("all", "1-URGENT")).select("o_custkey")


@R.frame("K10_script_sort_key", "SELECT p_partkey, 'a_' || lower(p_name) AS key FROM part")
def script_sort_key(spark, d):
    return table(spark, d, "part").select("p_partkey", T.script_sort_key(entities.normal_name("p_name", composed=True)).alias("key"))


@R.frame("U5_array_difference", "SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(string_split(lower(text), ' ')), lambda w: NOT list_contains(['the', 'of', 'and', ''], w))), ' ') AS names FROM documents WHERE text IS NOT NULL")
def array_difference(spark, d):
    common = F.array(*[F.lit(x) for x in ("the", "of", "and", "")])
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.array_sort(F.array_except(F.split(F.lower("text"), " "), common)), " ").alias("names"))


@R.frame("J33_listed_risk", "WITH l AS (SELECT url FROM pages WHERE page_id % 10 = 0), h AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS h FROM l) SELECT page_id, CASE WHEN url IN (SELECT url FROM l) THEN 'blocked' WHEN lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) IN (SELECT h FROM h) THEN 'high' ELSE 'safe' END AS risk FROM pages")
def listed_risk(spark, d):
    pages = table(spark, d, "pages")
    return intake.listed_risk(pages, pages.where("page_id % 10 = 0").select(F.col("url").alias("listed")), listed="listed").select("page_id", "risk")


@R.frame("V7_phish_lookup", "WITH l AS (SELECT DISTINCT url FROM pages WHERE page_id % 10 = 0) SELECT lower(regexp_extract(p.url, '^[A-Za-z]+://([^/?#]+)', 1)) AS host, count(*) AS pages, count(CASE WHEN l.url IS NOT NULL THEN 1 END) AS blocked FROM pages p LEFT JOIN l ON l.url = p.url GROUP BY 1")
def phish_lookup(spark, d):
    pages = table(spark, d, "pages")
    risk = intake.listed_risk(pages, pages.where("page_id % 10 = 0").select(F.col("url").alias("listed")), listed="listed")
    return risk.groupBy(C.url_host("url").alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("risk") == "blocked", 1)).alias("blocked"))


@R.frame("S30_list_index", "SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS domain, count(DISTINCT url) AS addresses FROM pages WHERE page_id % 10 = 0 GROUP BY 1")
def list_index(spark, d):
    return intake.bad_addresses(table(spark, d, "pages").where("page_id % 10 = 0"))[1]


@R.frame("P10_source_authority", "SELECT c_custkey, coalesce(p.a, s.a, 0.5) AS authority, CASE WHEN p.a IS NOT NULL THEN 'preset' WHEN s.a IS NOT NULL THEN 'stored' ELSE 'default' END AS origin FROM customer LEFT JOIN (SELECT n_nationkey AS h, 0.9 AS a FROM nation WHERE n_nationkey < 5) p ON p.h = c_nationkey LEFT JOIN (SELECT s_nationkey AS h, max(s_acctbal) / 10000 AS a FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s ON s.h = c_nationkey")
def source_authority(spark, d):
    presets = table(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("host"), F.lit(0.9).alias("authority"))
    stored = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("host"), (F.col("s_acctbal") / 10000).alias("authority"))
    return intake.authority(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("host")), presets, stored).select("c_custkey", "authority", "origin")


@R.frame("P26_authority_update", "SELECT coalesce(s_suppkey, c_custkey) AS host, coalesce(c_acctbal, s_acctbal) AS authority, CASE WHEN c_acctbal IS NOT NULL AND c_acctbal > 5000 THEN 1 ELSE 2 END AS tier, coalesce(c_mktsegment, s_name) AS note FROM supplier FULL JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = s_suppkey")
def authority_update(spark, d):
    stored = table(spark, d, "supplier").select(F.col("s_suppkey").alias("host"), F.col("s_acctbal").alias("authority"), F.lit(2).alias("tier"), F.col("s_name").alias("note"))
    changes = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("host"), F.col("c_acctbal").alias("authority"), F.when(F.col("c_acctbal") > 5000, 1).otherwise(2).alias("tier"), F.col("c_mktsegment").alias("note"))
    return intake.set_authority(stored, changes)


@R.frame("A36_recent_success", "SELECT count(*) AS total, count(CASE WHEN event_type <> 'error' THEN 1 END) AS succeeded, count(CASE WHEN event_type <> 'error' THEN 1 END) / count(*) AS rate FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def recent_success(spark, d):
    e = table(spark, d, "events")
    return intake.success_rate(e.join(F.broadcast(e.agg(F.max("ts").alias("last")))).where("ts >= last - INTERVAL 1 DAY"), F.col("event_type") != "error")


@R.frame("D2_expire_entries", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def expire_entries(spark, d):
    e = table(spark, d, "events")
    return intake.expire(e.join(F.broadcast(e.agg(F.max("ts").alias("last")))), F.col("last"), "ts").select("event_id", "ts")


@R.frame("J3_address_anti_join", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def address_anti_join(spark, d):
    pages = table(spark, d, "pages")
    return intake.new_rows(pages.select("url"), pages.where("page_id % 4 = 0").select("url"), "url")


@R.frame("P15_raw_insert", "SELECT source AS url, min(doc_id) AS doc_id FROM documents WHERE source IS NOT NULL GROUP BY source")
def raw_insert(spark, d):
    """Rows of addresses that are not there yet, after those that are."""
    docs = table(spark, d, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("url")).agg(F.min("doc_id").alias("doc_id"))
    old = docs.where("doc_id % 2 = 0")
    return old.unionByName(intake.new_rows(docs, old, "url"))


_RETRY = "r AS (SELECT event_id, user_id, CAST(event_id % 5 AS BIGINT) AS attempt, ts FROM events WHERE event_type = 'error')"


@R.frame("Y7_retry_queue", f"WITH {_RETRY} SELECT event_id, attempt >= 3 AS dead, CASE WHEN attempt < 3 THEN attempt + 1 END AS next_attempt, CASE WHEN attempt < 3 THEN ts + to_seconds(60 * pow(2, attempt)::BIGINT) END AS due FROM r")
def retry_queue(spark, d):
    failed = table(spark, d, "events").where("event_type = 'error'").withColumn("attempt", F.col("event_id") % 5)
    return intake.retry_plan(failed, failed_at="ts").select("event_id", "dead", "next_attempt", F.col("due").cast("timestamp_ntz").alias("due"))


@R.frame("Y8_retry_flush", f"WITH {_RETRY}, q AS (SELECT event_id, user_id, ts + to_seconds(60 * pow(2, attempt)::BIGINT) AS due FROM r WHERE attempt < 3), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY due) AS place FROM q WHERE due <= (SELECT max(ts) FROM events)) SELECT event_id, user_id, place FROM n WHERE place <= 3")
def retry_flush(spark, d):
    e = table(spark, d, "events")
    failed = e.where("event_type = 'error'").withColumn("attempt", F.col("event_id") % 5)
    plan = intake.retry_plan(failed, failed_at="ts").join(F.broadcast(e.agg(F.max("ts").cast("timestamp").alias("now"))))
    return intake.due_items(plan, F.col("now"), "user_id", 3).select("event_id", "user_id", "place")


def _titles(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"[#$%&*]", "").alias("title"))


@R.frame("D3_title_fingerprint")
def title_fingerprints(spark, d):
    return _titles(spark, d).select("id", F.lower(F.lpad(F.hex(intake.title_fingerprint("title")), 16, "0")).alias("fingerprint"))


@R.frame("D4_greedy_titles")
def greedy_titles(spark, d):
    """Fingerprints of titles that stay when pages come in order of their ids."""
    rows = tables.written(_titles(spark, d).select("id", intake.title_fingerprint("title").alias("fp")))
    return intake.greedy_keep(rows, "id").join(rows.groupBy("fp").agg(F.min("id").alias("id")), "fp").select("id")


@R.frame("S12_table_schema", "SELECT column_name AS name, data_type AS kind FROM (DESCRIBE SELECT * FROM lineitem) t(column_name, data_type, a, b, c, e)")
def table_schema(spark, d):
    df = table(spark, d, "lineitem")
    return tables.schema_of(df).select("name", F.when(F.col("kind") == "int", "INTEGER").when(F.col("kind") == "string", "VARCHAR").when(F.col("kind") == "timestamp_ntz", "TIMESTAMP").otherwise(F.upper("kind")).alias("kind"))


@R.frame("S13_table_key", "SELECT 'orders' AS name, 'o_orderkey' AS key, count(*) = count(DISTINCT o_orderkey) AS holds FROM orders UNION ALL SELECT 'labels', 'doc_id', count(*) = count(DISTINCT doc_id) FROM labels")
def table_key(spark, d):
    return tables.key_of("orders", table(spark, d, "orders")).unionByName(tables.key_of("labels", table(spark, d, "labels")))


@R.frame("S14_property_keys", "SELECT DISTINCT event_type AS label, 'k' AS key FROM events WHERE props IS NOT NULL")
def property_keys(spark, d):
    return tables.property_keys(table(spark, d, "events"), "event_type", "props")


@R.frame("S15_property_sample", "SELECT event_type AS label, min(event_id) AS sampled FROM events WHERE props IS NOT NULL GROUP BY event_type")
def property_sample(spark, d):
    return tables.property_sample(table(spark, d, "events"), "event_type", "event_id", "props").select("label", "sampled")


@R.frame("S24_verify_sink", "SELECT 'documents' AS name, count(*) AS found, TRUE AS whole FROM documents")
def verify_sink(spark, d):
    docs = table(spark, d, "documents")
    return tables.verified("documents", tables.written(docs.select("doc_id")), docs.select("doc_id"))


@R.frame("S18_upsert_rows", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def upsert_rows(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    newest = o.groupBy("o_custkey").agg(F.max("at").alias("m"))
    return tables.upsert(o.where("o_orderkey % 2 = 0").join(newest, "o_custkey", "left").where("at <= m").drop("m"), o.join(newest, "o_custkey").where("at = m").drop("m"), ["o_custkey"], "at").select("o_custkey", "o_orderkey")


@R.frame("S20_upsert_graph", "SELECT n_name AS name, max(n_regionkey) AS region FROM nation GROUP BY n_name")
def upsert_graph(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return tables.upsert(n.withColumn("region", F.lit(-1)), n, ["name"])


@R.frame("S21_edge_ids", "SELECT DISTINCT l_partkey || '_SUPPLIED_BY_' || l_suppkey AS id, l_partkey, l_suppkey FROM lineitem")
def edge_ids(spark, d):
    e = table(spark, d, "lineitem").select(F.concat_ws("_", F.col("l_partkey").cast("string"), F.lit("SUPPLIED_BY"), F.col("l_suppkey").cast("string")).alias("id"), "l_partkey", "l_suppkey")
    return tables.upsert(e.limit(0), e, ["id"])


@R.frame("S22_ensure_columns", "SELECT r_regionkey, r_name, CAST(NULL AS DOUBLE) AS score FROM region")
def ensure_columns(spark, d):
    return tables.ensure_columns(table(spark, d, "region"), {"score": "double", "r_name": "string"})


@R.frame("S25_migrate_tables", "SELECT 'nation' AS name, count(*) AS rows_there FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def migrate_tables(spark, d):
    target = tables.shared_dir(spark)
    tables.migrate(spark, {n: f"{d}/{n}.parquet" for n in ("nation", "region")}, target, {"nation": {"n_name": "name"}})
    both = [spark.read.parquet(f"{target}/{n}").groupBy().agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows_there")) for n in ("nation", "region")]
    return both[0].unionByName(both[1])


@R.frame("S29_index_since", "SELECT doc_id FROM documents WHERE doc_id > 50")
def index_since(spark, d):
    return tables.read_since(table(spark, d, "documents"), "doc_id", 50).select("doc_id")
