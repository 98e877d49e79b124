"""Filters, joins, aggregates, windows, paging and set operations over the driver's tables.

orders stand in for articles (status, score, time, customer as host), events for usage records (props.k as tokens, value as latency,
errors as failures), lineitem for mentions, nation and region for a two-level hierarchy of communities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import as_of, context
from .registry import Registry, table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

R.sql("S1_source_scan", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0 ORDER BY s_name, s_suppkey")
R.sql("S8_incremental_read", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500")
R.sql("S10_offset_read", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
R.sql("S16_labelled_scan", "SELECT 'nation' AS label, CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS BIGINT), r_name FROM region")
R.sql("S28_index_scan", "SELECT doc_id, source, length(text) AS n FROM documents WHERE text IS NOT NULL AND text <> '' AND source IN ('src0', 'src1', 'src2')".replace("length(text) AS n", "CAST(length(text) AS BIGINT) AS n"))
R.sql("F1_list_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_custkey < 500 AND o_totalprice >= 1000")
R.sql("F2_point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
R.sql("F3_existing_membership", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
R.sql("F4_pending_scan", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50")
R.sql("F5_stuck_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY")
R.sql("F6_incomplete_rows", "SELECT o.o_orderkey FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey) l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND (flag IS NULL OR o_orderpriority IS NULL)")
R.sql("F7_failed_retryable", "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND @JSON_K < 50")
R.sql("F8_usage_filter", "SELECT event_id, ts, value FROM events WHERE event_type = 'view' AND user_id < 100 ORDER BY ts DESC, event_id DESC LIMIT 200")
R.sql("F9_failure_filter", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200")
R.sql("F10_needs_review", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal < 0")
R.sql("F11_stale_pending", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 DAY")
R.sql("F13_entity_text_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%small%'")
R.sql("F15_names_in_list", "SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('FRANCE', 'GERMANY', 'NATION_3', 'NATION_7')")
R.sql("F16_community_text_search", "SELECT r_regionkey, r_name FROM region WHERE lower(r_name) LIKE '%a%' ORDER BY r_regionkey")
R.sql("F20_events_by_range", "SELECT event_id, ts FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events) AND (SELECT min(ts) FROM events) + INTERVAL 24 HOUR ORDER BY ts, event_id LIMIT 500")
R.sql("F21_orphans", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
R.sql("F22_tolerant_prune", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) = 0")
R.sql("F23_strict_prune", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.toxic = 1)")
R.sql("J1_vector_article_join", "SELECT vec_id, label, d.source, d.lang FROM embeddings JOIN documents d ON vec_id = d.doc_id")
R.sql("J4_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
R.sql("J5_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
R.sql("J8_unassigned_count", "SELECT count(*) AS unassigned FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.08)")
R.sql("J10_dangling_parent", "SELECT n.n_nationkey FROM nation n LEFT JOIN (SELECT r_regionkey FROM region WHERE r_regionkey <> 2) r ON n.n_regionkey = r.r_regionkey WHERE n.n_regionkey IS NOT NULL AND r.r_regionkey IS NULL")
R.sql("J11_member_counts", "SELECT r_regionkey, count(n_nationkey) AS members FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
R.sql("J13_co_mention", "SELECT DISTINCT b.l_partkey AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey = 7 AND b.l_partkey <> 7")
R.sql("J14_entity_articles", "SELECT DISTINCT l_partkey, o_orderkey, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey IN (1, 2, 3)")
R.sql("J15_article_entities", "SELECT DISTINCT l_orderkey, p_partkey, p_name, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey")
R.sql("J16_triangles", "SELECT DISTINCT a.l_orderkey, a.l_partkey AS e1, b.l_partkey AS e2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey JOIN lineitem c ON c.l_orderkey = b.l_partkey AND c.l_suppkey = a.l_suppkey")
R.sql("J17_related_articles", "SELECT DISTINCT o_orderkey, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey = 3 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
R.sql("J18_typed_neighbours", "SELECT l_suppkey AS other, 'out' AS direction, count(*) AS weight FROM lineitem WHERE l_partkey = 5 GROUP BY l_suppkey UNION ALL SELECT l_orderkey, 'in', count(*) FROM lineitem WHERE l_partkey = 5 GROUP BY l_orderkey")
R.sql("J20_touching_edges", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (1, 5, 9) OR l_suppkey IN (2, 4)")
R.sql("J22_members", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
R.sql("J23_key_entities", "SELECT n_regionkey, n_nationkey, count(s_suppkey) AS degree FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey ORDER BY degree DESC, n_nationkey LIMIT 10")
R.sql("J24_cross_community", "SELECT DISTINCT cn.n_regionkey AS c1, sn.n_regionkey AS c2, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey WHERE cn.n_regionkey <> sn.n_regionkey")
R.sql("J25_intra_community", "SELECT sn.n_regionkey AS community, l_suppkey, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey WHERE cn.n_regionkey = sn.n_regionkey GROUP BY sn.n_regionkey, l_suppkey ORDER BY weight DESC, l_suppkey LIMIT 30")
R.sql("J26_affected_communities", "SELECT DISTINCT n_regionkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 11))")
R.sql("J29_top_degree_snapshot", "WITH deg AS (SELECT l_partkey, count(*) AS degree FROM lineitem GROUP BY l_partkey ORDER BY degree DESC, l_partkey LIMIT 20) SELECT l.l_orderkey, l.l_partkey, degree FROM lineitem l JOIN deg ON deg.l_partkey = l.l_partkey")
R.sql("A1_global_summary", "SELECT count(*) AS calls, CAST(sum(@JSON_K) AS BIGINT) AS tokens, min(value) AS least, max(value) AS most, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM events")
R.sql("A2_errors_by_type", "SELECT coalesce(event_type, 'unknown') AS kind, count(*) AS n FROM events WHERE @JSON_K > 10 GROUP BY coalesce(event_type, 'unknown')")
R.sql("A3_by_provider", "SELECT user_id, count(*) AS calls, CAST(sum(@JSON_K) AS BIGINT) AS tokens FROM events GROUP BY user_id ORDER BY tokens DESC, user_id")
R.sql("A4_by_model", "SELECT user_id, event_type, count(*) AS calls, max(value) AS slowest FROM events GROUP BY user_id, event_type")
R.sql("A5_by_call_point", "SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
R.sql("A6_hourly_rollup", "SELECT @TRUNC(hour, ts) AS bucket, event_type, count(*) AS calls, count(value) AS valued, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
R.sql("A6_daily_rollup", "SELECT @TRUNC(day, ts) AS bucket, event_type, count(*) AS calls, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
R.sql("A6_monthly_rollup", "SELECT @TRUNC(month, ts) AS bucket, count(*) AS calls, CAST(sum(@JSON_K) AS BIGINT) AS tokens FROM events GROUP BY 1")
R.sql("A8_latency_bounds", "SELECT @TRUNC(hour, ts) AS bucket, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
R.sql("A10_counter_pivot", "SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS click, count(CASE WHEN event_type = 'error' THEN 1 END) AS error, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchase, count(CASE WHEN event_type = 'signup' THEN 1 END) AS signup, count(CASE WHEN event_type = 'view' THEN 1 END) AS viewed FROM events GROUP BY user_id")
R.sql("A13_failure_stats", "SELECT user_id, event_type, count(*) AS n, max(ts) AS last_seen FROM events WHERE event_type IN ('error', 'click') GROUP BY GROUPING SETS ((user_id, event_type), (user_id), (event_type), ())")
R.sql("A14_task_progress", "SELECT o_custkey, count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS working, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS pending FROM orders GROUP BY o_custkey")
R.sql("A15_queue_stats", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
R.sql("A16_status_histogram", "SELECT s.status, count(o_orderkey) AS n FROM (SELECT 'F' AS status UNION ALL SELECT 'O' UNION ALL SELECT 'P' UNION ALL SELECT 'X') s LEFT JOIN orders ON o_orderstatus = s.status GROUP BY s.status")
R.sql("A17_source_auto_score", "SELECT s_nationkey, round(avg(s_acctbal), 6) AS score FROM supplier WHERE s_acctbal IS NOT NULL GROUP BY s_nationkey")
R.sql("A19_filtered_count", "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM orders WHERE o_orderstatus = 'O'")
R.sql("A20_graph_counts", "SELECT (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM orders) AS articles, (SELECT count(*) FROM lineitem) AS mentions")
R.sql("A21_degrees", "SELECT p_partkey, count(DISTINCT l_suppkey) AS outgoing, count(DISTINCT l_orderkey) AS incoming FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
R.sql("A22_average_degree", "SELECT round(avg(d), 9) AS mean FROM (SELECT p_partkey, count(l_orderkey) AS d FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey) x")
R.sql("A24_high_degree", "SELECT l_partkey, count(*) AS degree FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30 ORDER BY degree DESC, l_partkey LIMIT 100")
R.sql("A25_type_distribution", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 20")
R.sql("A26_level_distribution", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
R.sql("A27_community_metrics", "SELECT count(*) AS communities, round(avg(size), 6) AS mean_size, max(size) AS largest, min(size) AS smallest FROM (SELECT n_regionkey, count(*) AS size FROM nation GROUP BY n_regionkey) x")
R.sql("A29_relation_types", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS targets FROM lineitem GROUP BY l_returnflag")
R.sql("A31_edge_collapse", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2")
R.sql("A32_count_aggregate", "SELECT user_id, count(*) AS events, least(1.0, count(*) / 10.0) >= 1.0 AS sure FROM events GROUP BY user_id")
R.sql("A34_provider_metrics", "SELECT user_id, CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS DOUBLE) / count(*) AS failure_rate FROM events GROUP BY user_id")
R.sql("A35_risk_max", "SELECT user_id, max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS risk FROM events GROUP BY user_id")
R.sql("W1_list_rank", "SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem")
R.sql("W3_keep_latest", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1")
R.sql("W5_event_neighbours", "SELECT event_id, lag(event_id, 2) OVER w AS before2, lag(event_id, 1) OVER w AS before1, lead(event_id, 1) OVER w AS after1, lead(event_id, 2) OVER w AS after2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
R.sql("W8_prefix_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(CAST(length(text) / 4.0 AS DECIMAL(18, 2))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) x WHERE used <= 400")
R.sql("W9_drop_over_three", "SELECT user_id, event_id, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value > 0.05 AS dropped FROM events")
R.sql("W10_percentiles", "SELECT event_type, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_cont(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM events GROUP BY event_type")
R.sql("K1_paged_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
R.sql("K4_community_paging", "SELECT n_nationkey, n_regionkey FROM nation ORDER BY n_regionkey, n_nationkey DESC LIMIT 10 OFFSET 5")
R.sql("K5_chain_paging", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 100")
R.sql("K9_stable_sections", "SELECT conv_id, turn, role FROM conversations ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, conv_id, turn")
R.sql("U1_union_all_types", "SELECT l_orderkey AS k, 'A' AS kind FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, 'R' FROM lineitem WHERE l_returnflag = 'R'")
R.sql("U3_concat_kinds", "SELECT 'pending' AS kind, o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'open', o_orderkey FROM orders WHERE o_orderstatus = 'O'")
R.sql("U4_difference", "SELECT l_suppkey FROM lineitem EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000")
R.sql("U4_intersection", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
R.sql("U6_distinct", "SELECT DISTINCT source, lang FROM documents")
R.sql("U7_assignment_diff", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'created' WHEN b.doc_id IS NULL THEN 'gone' ELSE 'both' END AS state FROM (SELECT doc_id FROM documents WHERE lang = 'en') a FULL OUTER JOIN (SELECT doc_id FROM labels WHERE quality = 1) b ON a.doc_id = b.doc_id")
R.sql("P13_upsert", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'F') x WHERE rn = 1")
R.sql("P16_fill_if_null", "SELECT d.doc_id, coalesce(l.quality, 1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
R.sql("P23_consistency", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labelled, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)) AS lost")
R.sql("P25_purge", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
R.sql("M2_temporal_chain", "SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS followed_by FROM events")


@R.frame("A9_hour_partial_aggregate", "SELECT @TRUNC(hour, ts) AS bucket, user_id % 16 AS shard, event_type, count(*) AS calls, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS latency FROM events GROUP BY 1, 2, 3")
def hour_partial(spark, folder):
    e = table(spark, folder, "events")
    whole = F.when(F.col("value") >= 0, F.floor("value")).otherwise(F.ceil("value"))
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket"), (F.col("user_id") % 16).alias("shard"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(whole.cast("long")).alias("latency"))


@R.frame("W4_gap_hours", "SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3600000000.0, 6) AS gap FROM events")
def gap_hours(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").select("event_id", F.round((us - F.lag(us).over(w)) / 3600000000.0, 6).alias("gap"))


@R.frame("J19_two_hops", "WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), one AS (SELECT p FROM e WHERE s = 1), two AS (SELECT DISTINCT e.s FROM e JOIN one USING (p)), three AS (SELECT DISTINCT e.p FROM e JOIN two USING (s)) SELECT p AS part, CASE WHEN p IN (SELECT p FROM one) THEN 1 ELSE 3 END AS hops FROM three")
def hops(spark, folder):
    """Frontier expansion: each hop joins the frontier's keys and drops what was reached before."""
    e = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    one = e.where("l_suppkey = 1").select("l_partkey").distinct()
    two = e.join(one, "l_partkey", "left_semi").select("l_suppkey").distinct()
    three = e.join(two, "l_suppkey", "left_semi").select("l_partkey").distinct()
    return three.join(one.withColumn("hops", F.lit(1)), "l_partkey", "left").select(F.col("l_partkey").alias("part"), F.coalesce("hops", F.lit(3)).alias("hops"))


@R.frame("F12_substring_preset", "SELECT DISTINCT page_id, s_suppkey FROM (SELECT page_id, url, CAST(unnest(regexp_extract_all(url, '/([0-9]+)', 1)) AS BIGINT) AS n FROM pages) JOIN supplier ON n = s_suppkey WHERE contains(url, '/' || s_suppkey)")
def substring_preset(spark, folder):
    """Suppliers whose number is a path part of an address: the numbers are taken out first, so the join is by value."""
    numbers = F.regexp_extract_all("url", F.lit(r"/([0-9]+)"), F.lit(1))
    pages = table(spark, folder, "pages").select("page_id", "url", F.explode(numbers).alias("n")).withColumn("s_suppkey", F.col("n").try_cast("bigint"))
    found = pages.join(table(spark, folder, "supplier").select("s_suppkey"), "s_suppkey")
    return found.where(F.contains("url", F.concat(F.lit("/"), F.col("s_suppkey").cast("string")))).select("page_id", "s_suppkey").distinct()


_STATES = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'pg_done' WHEN 'purchase' THEN 'neo4j_done' ELSE 'failed' END"


@R.frame("F26_transition_check", f"WITH s AS (SELECT event_id, user_id, ts, {_STATES} AS s FROM events), p AS (SELECT event_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM s), ok(a, b) AS (VALUES ('pending', 'processing'), ('pending', 'failed'), ('processing', 'pg_done'), ('processing', 'failed'), ('pg_done', 'neo4j_done'), ('pg_done', 'failed'), ('failed', 'pending')) SELECT event_id, s = n OR (s, n) IN (SELECT (a, b) FROM ok) AS allowed FROM p WHERE n IS NOT NULL")
def transition_check(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, folder, "events").select("event_id", "user_id", "ts", F.expr(_STATES).alias("s")).withColumn("n", F.lead("s").over(w))
    return steps.where("n IS NOT NULL").select("event_id", context.may_follow("s", "n").alias("allowed"))


@R.frame("J35_as_of_previous", "SELECT a.event_id, b.event_id AS previous FROM events a ASOF LEFT JOIN events b ON a.user_id = b.user_id AND a.ts > b.ts")
def as_of_previous(spark, folder):
    return as_of.previous(table(spark, folder, "events"), "user_id", "ts", "event_id")


@R.frame("D8_merge_group", "SELECT o_orderkey, m AS merged_into FROM orders JOIN (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS m FROM orders WHERE o_totalprice > 1000 GROUP BY 1) USING (o_custkey)")
def merge_group(spark, folder):
    """Each member of a group is merged into its latest one that has a body (here: a price)."""
    return as_of.merge_into_latest(table(spark, folder, "orders"), "o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice") > 1000)


@R.frame("D11_keep_newest", "SELECT max(doc_id) AS doc_id, length(text) AS n FROM documents GROUP BY text")
def keep_newest(spark, folder):
    docs = table(spark, folder, "documents")
    return as_of.text_groups(docs, "doc_id", "text").select(F.col("last").alias("doc_id"), "n")


@R.frame("A18_duplicate_groups", "SELECT min(doc_id) AS keeps, count(*) AS n, sha256(any_value(text)) AS text_sha256 FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, folder):
    found = as_of.text_groups(table(spark, folder, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return found.where("rows > 1").select(F.col("first").alias("keeps"), F.col("rows").alias("n"), F.col("digest").alias("text_sha256"))
