"""Entity names, causes, walks, community health, contexts and scores over the driver's tables, with their SQL.

Names are built from parts (names with brackets, cases and suffixes by row), events of a user are a chain, nations in regions are
communities whose stored counts and parents are made wrong by rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import context, entities, health, memory, retrieval
from .registry import Registry, table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

# Names of parts in variants: by key a bracket, capitals, a suffix, double spaces or quotes.
_NAMES = "n AS (SELECT p_partkey, p_brand, CASE p_partkey % 6 WHEN 0 THEN p_name || ' (' || p_brand || ')' WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || '  Corporation' WHEN 3 THEN '\"' || replace(p_name, ' ', '  ') || '\"' WHEN 4 THEN replace(p_name, ' ', ' - ') ELSE p_name END AS name FROM part)"
_CAP = "array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: CASE WHEN regexp_matches(w, '^[a-z]+$') THEN upper(w[1]) || w[2:] ELSE w END), '')"
_SPACED = "trim(regexp_replace(name, '\\s+', ' ', 'g'))"
_BARE = f"regexp_replace(regexp_replace({_SPACED}, '[\"''`]', '', 'g'), '\\s*[-–—]\\s*', '-', 'g')"
_NORMAL = f"""{_NAMES}, s AS (SELECT *, {_SPACED} AS spaced, {_BARE} AS bare FROM n), c AS (SELECT *, {_CAP.format("bare")} AS cased FROM s),
m AS (SELECT *, regexp_replace(cased, '\\s+Corporation$', ' Corp') AS normalized, (spaced <> name)::INTEGER + (bare <> spaced)::INTEGER + (cased <> bare)::INTEGER + regexp_matches(cased, '\\s+Corporation$')::INTEGER AS changed FROM c)"""


def _named(spark, d):
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    name = F.when(k == 0, F.concat(n, F.lit(" ("), "p_brand", F.lit(")"))).when(k == 1, F.upper(n)).when(k == 2, F.concat(n, F.lit("  Corporation")))
    name = name.when(k == 3, F.concat(F.lit('"'), F.replace(n, F.lit(" "), F.lit("  ")), F.lit('"'))).when(k == 4, F.replace(n, F.lit(" "), F.lit(" - "))).otherwise(n)
    return table(spark, d, "part").select("p_partkey", "p_brand", name.alias("name"))


@R.frame("X11_normal_name", f"WITH {_NORMAL} SELECT p_partkey, normalized, 'english' AS script, CAST(changed AS INTEGER) AS n_changes, CASE WHEN changed = 0 THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence FROM m")
def x11(spark, d):
    rows = _named(spark, d).select("p_partkey", entities.normal_name("name", True).alias("n"))
    return rows.select("p_partkey", "n.normalized", "n.script", F.size("n.changes").alias("n_changes"), "n.confidence")


_SCORE = "2.0 + CASE WHEN length(normalized) BETWEEN 2 AND 50 THEN 5.0 ELSE 0.0 END + CASE WHEN changed = 0 THEN 3.0 + 5.0 ELSE 4.75 END"


@R.frame("X14_canonical_score", f"WITH {_NORMAL} SELECT p_partkey, ({_SCORE})::DOUBLE AS score FROM m")
def x14(spark, d):
    return _named(spark, d).select("p_partkey", entities.normal_name("name", True).alias("n")).select("p_partkey", entities.canonical_score(F.col("n")).alias("score"))


@R.frame("D20_best_name", f"WITH {_NORMAL.replace('\\s+Corporation', '\\s+NoSuffixHere')} SELECT p_brand, arg_min(normalized, (-({_SCORE}), name)) AS canonical FROM (SELECT p_brand, name, normalized, changed FROM m) GROUP BY p_brand")
def d20(spark, d):
    return entities.best_name(_named(spark, d), "p_brand")


_PAIRS = f"{_NAMES}, p AS (SELECT a.p_partkey AS k, a.name AS a, b.name AS b FROM n a JOIN n b ON b.p_partkey = a.p_partkey + 1 UNION ALL SELECT p_partkey, p_name, p_name || ' (' || p_brand || ')' FROM part UNION ALL SELECT p_partkey, p_name, upper(p_name) FROM part)"
_BASE = "regexp_replace({0}, '^(.+?)\\s*\\(([^)]+)\\)\\s*$', '\\1')"


def _pairs(spark, d):
    n, p = _named(spark, d), table(spark, d, "part")
    near = n.select(F.col("p_partkey").alias("k"), F.col("name").alias("a")).join(n.select((F.col("p_partkey") - 1).alias("k"), F.col("name").alias("b")), "k")
    return near.unionByName(p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("b"))).unionByName(p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), F.upper("p_name").alias("b")))


@R.frame("X15_equivalence", f"WITH {_PAIRS} SELECT k, a, b, CASE WHEN a = b THEN 1.0 WHEN lower(a) = lower(b) THEN 0.95 WHEN trim(regexp_replace(a, '(Corporation)$', '')) = trim(regexp_replace(b, '(Corporation)$', '')) THEN 0.85 WHEN {_BASE.format('a')} = {_BASE.format('b')} THEN 0.90 ELSE 0.0 END::DOUBLE AS same FROM p")
def x15(spark, d):
    return _pairs(spark, d).select("k", "a", "b", entities.equivalence(F.col("a"), F.col("b")).alias("same"))


@R.frame("D14_match_rules", f"WITH {_PAIRS} SELECT k, a, b, CASE WHEN a = b THEN 'exact' WHEN lower(a) = lower(b) THEN 'case' WHEN {_BASE.format('a')} = {_BASE.format('b')} THEN 'bracket' END AS rule FROM p")
def d14(spark, d):
    return _pairs(spark, d).select("k", "a", "b", entities.match_rule("a", "b")["rule"].alias("rule"))


_METRIC_NAMES = "CASE o_orderkey % 4 WHEN 0 THEN price || '亿元' WHEN 2 THEN price || ' %' WHEN 1 THEN o_orderpriority ELSE 'Order ' || price END"


@R.frame("X16_metric_names", f"SELECT o_orderkey, regexp_matches(name, '^[0-9,.]+\\s*(%|[万亿]元|[万亿]?股|[万亿千百十]+[元股人]?)$') AS metric FROM (SELECT o_orderkey, {_METRIC_NAMES} AS name FROM (SELECT *, format('{{:,.2f}}', o_totalprice) AS price FROM orders))")
def x16(spark, d):
    price = F.format_number("o_totalprice", 2)
    name = F.when(F.col("o_orderkey") % 4 == 0, F.concat(price, F.lit("亿元"))).when(F.col("o_orderkey") % 4 == 2, F.concat(price, F.lit(" %"))).when(F.col("o_orderkey") % 4 == 1, F.col("o_orderpriority")).otherwise(F.concat(F.lit("Order "), price))
    return table(spark, d, "orders").select("o_orderkey", entities.is_metric(name).alias("metric"))


@R.frame("X17_category", "SELECT event_id, CASE event_type WHEN 'view' THEN '科技' WHEN 'click' THEN '经济' ELSE '社会' END AS category, CASE event_type WHEN 'error' THEN '恐慌' ELSE event_type END AS mood FROM events")
def x17(spark, d):
    raw = F.when(F.col("event_type") == "view", " Tech ").when(F.col("event_type") == "click", "BUSINESS").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", entities.category(raw).alias("category"), entities.emotion(F.when(F.col("event_type") == "error", "Fear").otherwise(F.col("event_type"))).alias("mood"))


_RAW_TYPE = "CASE event_id % 5 WHEN 0 THEN '收购了' WHEN 1 THEN '控制的关系' WHEN 2 THEN 'supplies' WHEN 3 THEN '合作' ELSE event_type END"


@R.frame("X18_relation_type", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ACQUIRES' WHEN 1 THEN 'CONTROLS' WHEN 2 THEN 'SUPPLIES' WHEN 3 THEN 'PARTNERS_WITH' END AS kind FROM events")
def x18(spark, d):
    return table(spark, d, "events").withColumn("raw", F.expr(_RAW_TYPE)).select("event_id", entities.relation_type("raw").alias("kind"))


@R.frame("X19_unknown_types", "SELECT event_type AS raw_type, count(*) AS hit_count, max(event_id) AS last_seen FROM events WHERE event_id % 5 = 4 GROUP BY event_type")
def x19(spark, d):
    return entities.unknown_types(table(spark, d, "events").withColumn("raw", F.expr(_RAW_TYPE)), "raw", "event_id")


# Known entities: the names of parts with even keys in capitals on each word, the first part's brand an alias of the name.
_KNOWN = f"k AS (SELECT DISTINCT {_CAP.format('p_name')} AS entity FROM part WHERE p_partkey % 2 = 0), al AS (SELECT p_brand AS alias, min({_CAP.format('p_name')}) AS entity FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)"


def _resolved(spark, d):
    p = table(spark, d, "part")
    cap = entities.normal_name("p_name", composed=True)["normalized"]
    known = p.where("p_partkey % 2 = 0").select(cap.alias("name"), F.lit("产品").alias("kind"), "p_brand").groupBy("name", "kind").agg(F.array_sort(F.collect_set("p_brand")).alias("aliases")).withColumn("description", F.lit(None).cast("string"))
    asked = p.select(F.col("p_name").alias("name")).unionByName(p.select(F.col("p_brand").alias("name"))).unionByName(p.select(F.concat_ws(" ", "p_type", "p_brand").alias("name"))).withColumn("kind", F.lit("产品"))
    return known, entities.resolve(asked, known)


_ASKED = "q AS (SELECT p_name AS name FROM part UNION SELECT p_brand FROM part UNION SELECT p_type || ' ' || p_brand FROM part)"
_RESOLVED = f"WITH {_KNOWN}, {_ASKED}, r AS (SELECT q.name, coalesce(k.entity, al.entity) AS entity, CASE WHEN k.entity IS NOT NULL THEN 'normal' WHEN al.entity IS NOT NULL THEN 'alias' END AS how FROM q LEFT JOIN k ON k.entity = {_CAP.format('q.name')} LEFT JOIN al ON al.alias = q.name)"


@R.frame("D12_resolve_names", f"{_RESOLVED} SELECT name, entity, how FROM r")
def d12(spark, d):
    return _resolved(spark, d)[1].select("name", "entity", "how")


@R.frame("D21_merge_entities", f"{_RESOLVED} SELECT coalesce(k.entity, x.name) AS name, k.entity IS NULL AS created FROM k FULL JOIN (SELECT DISTINCT name FROM r WHERE entity IS NULL) x ON FALSE")
def d21(spark, d):
    known, found = _resolved(spark, d)
    return entities.merge_entities(known, found).join(known.select("name", F.lit(True).alias("old")), "name", "left").select("name", F.col("old").isNull().alias("created"))


@R.frame("D25_merge_relations", "SELECT l_partkey AS src, l_suppkey AS dst, CASE l_returnflag WHEN 'A' THEN 'SUPPLIES' ELSE l_returnflag END AS type, round(1 + 0.1 * (count(*) - 1), 6)::DOUBLE AS weight, count(*) AS mentions FROM lineitem GROUP BY 1, 2, 3")
def d25(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(F.col("l_returnflag") == "A", "供货").otherwise(F.col("l_returnflag")).alias("type"))
    return entities.merge_relations(m).withColumn("weight", F.round("weight", 6))


# Causal edges: lines of an order lead from the part to the supplier; the return flag is the type, the discount gives the confidence.
_CAUSES = "c AS (SELECT l_suppkey AS src, l_partkey % 200 + 100000 AS dst, CASE l_returnflag WHEN 'A' THEN 'CAUSES' WHEN 'N' THEN 'ENABLES' ELSE 'PREVENTS' END AS type, max(round(0.5 + l_discount * 5, 3)) AS confidence, arg_max(l_linestatus, (l_orderkey, l_linenumber, l_linestatus)) AS evidence FROM lineitem WHERE round(0.5 + l_discount * 5, 3) >= 0.7 GROUP BY ALL)"


def _causes(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "CAUSES").when(F.col("l_returnflag") == "N", "ENABLES").otherwise("PREVENTS")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 200 + 100000).alias("dst"), kind.alias("type"), F.round(0.5 + F.col("l_discount") * 5, 3).alias("confidence"), F.col("l_linestatus").alias("evidence"), F.struct("l_orderkey", "l_linenumber").alias("seen"))
    return memory.merge_causes(rows)


@R.frame("M3_merge_causes", f"WITH {_CAUSES} SELECT src, dst, type, confidence, evidence FROM c")
def m3(spark, d):
    return _causes(spark, d)


# Steps of a chain: from an event to the user's next one; every seventh step prevents.
_STEPS = "s AS (SELECT * FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, CASE event_id % 7 WHEN 0 THEN 'PREVENTS' WHEN 1 THEN 'ENABLES' ELSE 'CAUSES' END AS type, value AS confidence FROM events) x WHERE dst IS NOT NULL)"


def _steps(spark, d):
    from pyspark.sql import Window

    kind = F.when(F.col("event_id") % 7 == 0, "PREVENTS").when(F.col("event_id") % 7 == 1, "ENABLES").otherwise("CAUSES")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_id").alias("src"), F.lead("event_id").over(w).alias("dst"), kind.alias("type"), F.col("value").alias("confidence")).where("dst IS NOT NULL")


@R.frame("M4_causal_chain", f"WITH RECURSIVE {_STEPS}, b AS (SELECT src, dst FROM s WHERE type <> 'PREVENTS'), r AS (SELECT event_id AS event, event_id AS node, 0 AS distance FROM events WHERE event_type = 'error' UNION ALL SELECT r.event, b.src, r.distance + 1 FROM r JOIN b ON b.dst = r.node WHERE r.distance < 4) SELECT event, node, CAST(min(distance) AS INTEGER) AS distance FROM r WHERE node <> event GROUP BY event, node")
def m4(spark, d):
    return memory.causal_chain(_steps(spark, d), table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("event")), 4)


@R.frame("M5_causes", f"WITH {_STEPS} SELECT dst AS event, src AS node, type, confidence FROM s WHERE type <> 'PREVENTS' AND dst IN (SELECT event_id FROM events WHERE event_type = 'error')")
def m5(spark, d):
    return memory.near_causes(_steps(spark, d), table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("event")))


_W = "CASE intent WHEN 'why' THEN CASE kind WHEN 'causal' THEN 5.0 ELSE 2.0 END WHEN 'when' THEN CASE kind WHEN 'causal' THEN 1.0 ELSE 5.0 END ELSE CASE kind WHEN 'causal' THEN 1.5 ELSE 1.0 END END"


@R.frame("M6_transition", f"SELECT event_id, round(exp({_W} + 0.25), 6) AS score FROM (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'why' WHEN 1 THEN 'when' ELSE 'all' END AS intent, CASE WHEN event_type = 'error' THEN 'causal' ELSE 'temporal' END AS kind FROM events)")
def m6(spark, d):
    u = F.col("user_id") % 3
    intent, kind = F.when(u == 0, "why").when(u == 1, "when").otherwise("all"), F.when(F.col("event_type") == "error", "causal").otherwise("temporal")
    return table(spark, d, "events").select("event_id", F.round(memory.transition(intent, kind, F.lit(0.5)), 6).alias("score"))


@R.frame("M7_beam_search", f"WITH RECURSIVE {_STEPS}, w AS (SELECT src, dst, CASE type WHEN 'PREVENTS' THEN 'temporal' ELSE 'causal' END AS kind FROM s), r AS (SELECT event_id AS query, event_id AS node, 0.0::DOUBLE AS score, 0 AS depth FROM events WHERE event_type = 'signup' UNION ALL SELECT r.query, w.dst, r.score * 0.9 + exp(CASE w.kind WHEN 'causal' THEN 5.0 ELSE 2.0 END), r.depth + 1 FROM r JOIN w ON w.src = r.node WHERE r.depth < 5) SELECT query, node, round(score, 6) AS score, CAST(depth AS INTEGER) AS depth FROM r")
def m7(spark, d):
    edges = _steps(spark, d).select("src", "dst", F.when(F.col("type") == "PREVENTS", "temporal").otherwise("causal").alias("kind"))
    anchors = table(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("query"), F.lit("why").alias("intent"), F.col("event_id").alias("node"))
    return memory.beam_search(edges, anchors).withColumn("score", F.round("score", 6))


@R.frame("M14_pack_context", "WITH r AS (SELECT *, sum(length(coalesce(text, '')) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC, turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations) SELECT conv_id, coalesce(string_agg(CASE WHEN n <= 200 THEN coalesce(text, '') END, chr(10) ORDER BY turn DESC), '') AS context, CAST(coalesce(max(CASE WHEN n <= 200 THEN n END), 0) AS BIGINT) AS used, count(CASE WHEN n <= 200 THEN 1 END) AS kept, count(CASE WHEN n > 200 THEN 1 END) AS dropped FROM r GROUP BY conv_id")
def m14(spark, d):
    packed = memory.pack_context(table(spark, d, "conversations"), 200, "conv_id", "turn", "turn")
    return packed.select("conv_id", "context", "used", F.size("kept").cast("long").alias("kept"), F.size("dropped").cast("long").alias("dropped"))


# Communities of suppliers by nation; the region is the parent. Counts are off for every fourth nation, parents lost for every fifth.
_COMM = "c AS (SELECT n_nationkey AS community, CASE WHEN n_nationkey % 5 = 4 THEN 99 ELSE n_regionkey END AS parent, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + CASE WHEN n_nationkey % 4 = 3 THEN 2 ELSE 0 END AS entity_count FROM nation UNION ALL SELECT 1000 + n_nationkey, NULL, 0 FROM nation WHERE n_nationkey < 2), a AS (SELECT s_nationkey AS community, count(DISTINCT s_suppkey) AS actual FROM supplier GROUP BY 1)"


def _communities(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    members = s.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community"))
    size = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("size"))
    made = n.join(size, "n_nationkey", "left").select(F.col("n_nationkey").alias("community"), F.when(F.col("n_nationkey") % 5 == 4, 99).otherwise(F.col("n_regionkey")).alias("parent"), (F.coalesce("size", F.lit(0)) + F.when(F.col("n_nationkey") % 4 == 3, 2).otherwise(0)).alias("entity_count"))
    made = made.unionByName(n.where("n_nationkey < 2").select((F.col("n_nationkey") + 1000).alias("community"), F.lit(None).cast("int").alias("parent"), F.lit(0).cast("long").alias("entity_count")))
    newest = F.lit("2024-06-30").cast("timestamp")
    reports = n.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("community"), (F.col("n_nationkey") % 6 == 1).alias("stale"), F.when(F.col("n_nationkey") % 6 == 2, newest - F.expr("INTERVAL 8 DAYS")).otherwise(newest).alias("updated_at"))
    return made, members, reports, newest


_ISSUES = f"""{_COMM}, e AS (SELECT c.*, coalesce(a.actual, 0) AS actual FROM c LEFT JOIN a USING (community)),
i AS (SELECT community, 'empty' AS issue FROM e WHERE actual = 0 UNION ALL SELECT community, 'count_mismatch' FROM e WHERE actual > 0 AND entity_count <> actual
UNION ALL SELECT community, 'missing_report' FROM e WHERE community % 3 = 0 OR community >= 1000 UNION ALL SELECT community, 'stale_report' FROM e WHERE community < 1000 AND community % 6 IN (1, 2)
UNION ALL SELECT community, 'hierarchy_break' FROM e WHERE parent = 99)"""


@R.frame("G21_community_issues", f"WITH {_ISSUES} SELECT community, issue FROM i")
def g21(spark, d):
    c, m, r, now = _communities(spark, d)
    return health.issues(c, m, r, now)


@R.frame("G22_community_score", f"WITH {_ISSUES}, t AS (SELECT (SELECT count(*) FROM c) AS n, count(*) FILTER (issue = 'empty') AS e, count(*) FILTER (issue = 'count_mismatch') AS m, count(*) FILTER (issue = 'missing_report') AS r, count(*) FILTER (issue = 'stale_report') AS s, count(*) FILTER (issue = 'hierarchy_break') AS h FROM i), q AS (SELECT greatest(0, 100.0 - CASE WHEN e / n >= 0.10 THEN 30 WHEN e / n >= 0.05 THEN 15 ELSE 0 END - CASE WHEN m / n > 0.20 THEN 10 ELSE 0 END - CASE WHEN r / n > 0.30 THEN 10 ELSE 0 END - CASE WHEN s > 0 THEN 5 ELSE 0 END - CASE WHEN h > 0 THEN 15 ELSE 0 END)::DOUBLE AS score FROM t) SELECT score, CASE WHEN score >= 80 THEN 'healthy' WHEN score >= 60 THEN 'moderate' WHEN score >= 40 THEN 'degraded' ELSE 'critical' END AS status FROM q")
def g22(spark, d):
    c, m, r, now = _communities(spark, d)
    return health.community_score(c, health.issues(c, m, r, now))


@R.frame("G23_repair", f"WITH {_COMM} SELECT community, CASE WHEN parent IN (SELECT community FROM c JOIN a USING (community)) THEN parent END AS parent, actual AS entity_count FROM c JOIN a USING (community)")
def g23(spark, d):
    c, m, _, _ = _communities(spark, d)
    return health.repair(c, m)


@R.frame("G25_drifted", f"WITH {_COMM} SELECT community, entity_count AS stored, coalesce(actual, 0) AS actual FROM c LEFT JOIN a USING (community) WHERE abs(entity_count - coalesce(actual, 0)) > 0.2 * entity_count")
def g25(spark, d):
    c, m, _, _ = _communities(spark, d)
    return health.drifted(c, m)


@R.frame("G10_build_communities", "SELECT s_nationkey AS community, 0 AS level, count(*) AS entity_count, least(count(*) / 10.0, 10.0)::DOUBLE AS rank, any_value(n_regionkey) AS parent FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def g10(spark, d):
    members = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community"))
    return health.build_communities(members, 0, table(spark, d, "nation").select(F.col("n_nationkey").alias("community"), F.col("n_regionkey").alias("parent"))).select("community", "level", "entity_count", "rank", "parent")


@R.frame("G18_assignment_changes", "SELECT c_custkey AS node, b AS before, a AS after, CASE WHEN b IS NULL THEN 'assigned' WHEN a IS NULL THEN 'removed' ELSE 'moved' END AS change FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END AS b, CASE WHEN c_custkey % 10 <> 1 THEN CASE WHEN c_custkey % 10 = 2 THEN 99 ELSE c_nationkey END END AS a FROM customer) WHERE a IS DISTINCT FROM b")
def g18(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community"))
    return health.assignment_changes(c.where("node % 10 <> 0"), c.where("node % 10 <> 1").withColumn("community", F.when(F.col("node") % 10 == 2, 99).otherwise(F.col("community"))))


@R.frame("G6_graph_health", "WITH g AS (SELECT p_partkey, count(l_orderkey) AS d FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 48 GROUP BY p_partkey), t AS (SELECT count(*) AS n, count(*) FILTER (d = 0) AS o, avg(d) AS m, max(d) AS big FROM g) SELECT round(greatest(0, least(100, 100 - 30 * o / n - 20 * (1 - big / n) - CASE WHEN m < 1 THEN 20 WHEN m < 2 THEN 10 ELSE 0 END)), 6)::DOUBLE AS score, list_filter([CASE WHEN o / n > 0.1 THEN 'orphans' END, CASE WHEN m < 1.5 THEN 'sparse' END, CASE WHEN o > 10 THEN 'components' END], lambda x: x IS NOT NULL)::VARCHAR AS advice FROM t")
def g6(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 48").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("d"))
    g = table(spark, d, "part").select("p_partkey").join(lines, "p_partkey", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    t = g.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("d") == 0).cast("long")).alias("o"), F.avg("d").alias("m"), F.max("d").alias("big"))
    named = health.advice("n", "o", "o", "m")
    return t.select(F.round(health.graph_score("n", "o", "big", "m"), 6).alias("score"), F.concat(F.lit("["), F.array_join(named, ", "), F.lit("]")).alias("advice"))


@R.frame("G15_update_due", "SELECT o_orderkey, o_custkey % 60 >= 50 OR (o_custkey % 60 > 0 AND o_orderkey % 45 >= 30) OR (o_orderkey % 200) / 1000.0 > 0.1 OR o_orderkey % 9 >= 7 AS due FROM orders")
def g15(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", health.update_due(c % 60, k % 45, (k % 200) / 1000.0, k % 9).alias("due"))


@R.frame("P9_credibility", "SELECT o_orderkey, round(s * src + c * con + t * tim, 2) AS score FROM (SELECT o_orderkey, CASE p WHEN 0 THEN 0.25 WHEN 1 THEN 0.45 WHEN 2 THEN 0.30 ELSE 0.40 END AS s, CASE p WHEN 0 THEN 0.25 WHEN 1 THEN 0.35 WHEN 2 THEN 0.50 ELSE 0.40 END AS c, CASE p WHEN 0 THEN 0.50 ELSE 0.20 END AS t, CASE WHEN o_custkey % 3 = 0 THEN 0.5 ELSE (o_custkey % 97) / 97.0 END::DOUBLE AS src, ((o_orderkey % 89) / 89.0)::DOUBLE AS con, 0.65::DOUBLE AS tim FROM (SELECT *, o_orderkey % 4 AS p FROM orders)) WHERE abs((s * src + c * con + t * tim) * 100 - floor((s * src + c * con + t * tim) * 100) - 0.5) > 0.000001")
def p9(spark, d):
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "政治").when(k == 1, "经济").when(k == 2, "科技").otherwise("文化")
    source, content = F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 97) / 97.0), (F.col("o_orderkey") % 89) / 89.0
    s, c, t = (F.when(k == 0, a).when(k == 1, b).when(k == 2, e).otherwise(f) for a, b, e, f in ((0.25, 0.45, 0.30, 0.40), (0.25, 0.35, 0.50, 0.40), (0.50, 0.20, 0.20, 0.20)))
    raw = (s * F.coalesce(source, F.lit(0.5)) + c * content + t * 0.65) * 100  # what lies on a rounding edge is left out on both sides
    return table(spark, d, "orders").where(F.abs(raw - F.floor(raw) - 0.5) > 0.000001).select("o_orderkey", context.credibility(kind, source, content, F.lit(0.65)).alias("score"))


@R.frame("P17_transitions", "SELECT a.o_orderkey, (a.s = b.s OR (a.s = 'pending' AND b.s IN ('processing', 'failed')) OR (a.s = 'processing' AND b.s IN ('pg_done', 'failed')) OR (a.s = 'failed' AND b.s = 'pending')) AS allowed FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' ELSE 'failed' END AS s FROM orders) a JOIN (SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'pg_done' ELSE 'failed' END AS s FROM orders) b USING (o_orderkey)")
def p17(spark, d):
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey") % 4
    old = F.when(k == 0, "pending").when(k == 1, "processing").otherwise("failed")
    new = F.when(c == 0, "pending").when(c == 1, "processing").when(c == 2, "pg_done").otherwise("failed")
    return table(spark, d, "orders").select("o_orderkey", context.may_follow(old, new).alias("allowed"))


@R.frame("P24_retry_batch", "SELECT user_id, CAST(CASE WHEN ok / n >= 0.8 THEN least(n * 2, 50) ELSE greatest(n // 2, 5) END AS BIGINT) AS batch FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok FROM events GROUP BY user_id)")
def p24(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") != "error").cast("int")).alias("ok"))
    return per.select("user_id", context.retry_batch("n", F.col("ok") / F.col("n")).alias("batch"))


@R.frame("R21_local_context", """WITH q AS (SELECT p_partkey AS query, p_partkey AS entity FROM part WHERE p_partkey % 50 = 0), rel AS (SELECT l_partkey AS src, l_suppkey + 1000000 AS dst, l_returnflag AS type, count(*) AS weight FROM lineitem GROUP BY ALL),
x AS (SELECT query, 'entities' AS section, entity::VARCHAR AS item, 0.0 AS s, 0 AS t FROM q UNION ALL SELECT query, 'relations', src::VARCHAR || ' ' || type || ' ' || dst::VARCHAR, weight, 0 FROM rel JOIN q ON entity = src
UNION ALL SELECT query, 'articles', l_orderkey::VARCHAR, 1.0, epoch_us(max(o_orderdate)) FROM lineitem JOIN q ON entity = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY query, l_orderkey)
SELECT query, section, item, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query, section ORDER BY s DESC, t DESC, item) AS place FROM x) WHERE place <= 20""")
def r21(spark, d):
    line = table(spark, d, "lineitem")
    asked = table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), F.col("p_partkey").alias("entity"))
    relations = line.groupBy(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"), F.col("l_returnflag").alias("type")).agg(F.count(F.lit(1)).alias("weight"))  # no part has a supplier's number
    mentions = line.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("article"), F.col("l_partkey").alias("entity"), F.col("o_orderdate").alias("at"))
    return context.local_context(asked, relations, mentions, told=F.concat_ws(" ", "src", "type", 999999 - F.col("dst")))


@R.frame("R25_confidence", "SELECT l_orderkey, CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(1, 0.5 + least(0.2, 0.02 * n) + least(0.2, 0.01 * s) - CASE WHEN q < 500 THEN 0.2 ELSE 0 END)) END::DOUBLE AS answer, (0.5 + CASE WHEN n >= 3 THEN 0.1 ELSE 0 END + CASE WHEN q > 500 THEN 0.2 WHEN q > 200 THEN 0.1 ELSE 0 END)::DOUBLE AS whole FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS s, CAST(sum(l_quantity::BIGINT) AS BIGINT) * 5 AS q FROM lineitem GROUP BY 1)")
def r25(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("s"), (F.sum(F.col("l_quantity").cast("long")) * 5).alias("q"))
    return per.select("l_orderkey", context.local_confidence("n", "n", "s", "q").alias("answer"), context.global_confidence("n", "q", F.lit(1)).alias("whole"))


@R.frame("R30_route", "SELECT conv_id, turn, CASE WHEN regexp_matches(q, '\\b(why|cause[sd]?|because|reason)\\b') OR regexp_matches(q, '\\b(when|date|year|before|after)\\b') THEN 'local' WHEN regexp_matches(q, '\\b(relat\\w+|between|through)\\b') THEN 'global' WHEN regexp_matches(q, '\\b(who|what|which|where)\\b') THEN 'local' ELSE 'global' END AS engine FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'why ' WHEN 1 THEN 'what between ' WHEN 2 THEN 'who ' ELSE '' END || role AS q FROM conversations)")
def r30(spark, d):
    t = F.col("turn") % 4
    q = F.concat(F.when(t == 0, "Why ").when(t == 1, "What between ").when(t == 2, "Who ").otherwise(""), "role")
    return table(spark, d, "conversations").select("conv_id", "turn", context.route(context.intent(q)).alias("engine"))


_KNN = "s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0), k AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 20)"


def _nearest(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.knn(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 20)


@R.frame("R6_keyword_rescore", f"WITH {_KNN} SELECT query_id, id, round(0.7 * similarity + 0.3 * (contains(lower(coalesce(text, '')), 'tion')::INTEGER + contains(lower(coalesce(text, '')), 'der')::INTEGER) / 2.0, 6) AS score FROM k JOIN documents ON doc_id = id")
def r6(spark, d):
    hits = _nearest(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").withColumn("query", F.lit("Tion, der"))
    return context.keyword_rescore(hits).select("query_id", "id", F.round("score", 6).alias("score"))


# A query's text is the beginning of the document of its number; its lexical list is over all documents.
_TOK = "list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_LEXICAL = f"""wd AS MATERIALIZED (SELECT doc_id, {_TOK.format("coalesce(text, '')")} AS words FROM documents), ps AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM wd) GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT vec_id AS query_id, unnest({_TOK.format("array_to_string(string_split(text, ' ')[1:8], ' ')")}) AS term FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0) GROUP BY ALL),
st AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM wd), df AS (SELECT term, count(*) AS df FROM ps GROUP BY term),
bs AS (SELECT query_id, doc_id AS id, round(sum(greatest(0, ln(1 + (docs - df + 0.5) / (df + 0.5))) * times * tf / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))), 6) AS score FROM ps JOIN qt USING (term) JOIN df USING (term) JOIN wd USING (doc_id), st GROUP BY ALL),
l AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs) WHERE rank <= 20)"""


def _lexical(spark, d):
    docs = table(spark, d, "documents")
    starts = docs.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", " ", 9), 1, 8), " ").alias("query"))
    queries = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")).join(starts, "query_id")
    return retrieval.bm25_top(docs, queries, 20).select("query_id", "id", "rank")


_FUSED = f"{_KNN}, {_LEXICAL}, f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM k UNION ALL SELECT query_id, id, rank FROM l) GROUP BY 1, 2)"


@R.frame("R13_hybrid_search", f"WITH {_FUSED}, a AS (SELECT query_id, id, score * exp(-ln(2) / 30 * (id % 40)) AS score FROM f JOIN documents ON doc_id = id) SELECT query_id, id, round(score, 9) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS place FROM a) WHERE place <= 10")
def r13(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 40).cast("double").alias("age"))
    return context.hybrid_search(_lexical(spark, d), _nearest(spark, d), texts, 10, "age").withColumn("score", F.round("score", 9))


@R.frame("R10_fusion_quality", f"WITH {_FUSED} SELECT query_id, (least(count(*), 10) / 10.0)::DOUBLE AS filled, count(DISTINCT id) AS distinct_items, count(*) AS fused FROM f GROUP BY query_id")
def r10(spark, d):
    lists = _lexical(spark, d).withColumn("list", F.lit("lexical")).unionByName(_nearest(spark, d).select("query_id", "id", "rank", F.lit("vector").alias("list")))
    return context.fusion_quality(retrieval.reciprocal_rank_fusion(lists, by=("query_id",)), lists)


@R.frame("R9_weighted_rrf", f"WITH {_KNN}, {_LEXICAL} SELECT query_id, id, round(sum(score), 9) AS score FROM (SELECT query_id, id, 0.75 / (60 + rank) AS score FROM k UNION ALL SELECT query_id, id, 0.25 / (60 + rank) FROM l) GROUP BY 1, 2")
def r9(spark, d):
    lists = _lexical(spark, d).withColumn("list", F.lit("lexical")).unionByName(_nearest(spark, d).select("query_id", "id", "rank", F.lit("vector").alias("list")))
    return retrieval.reciprocal_rank_fusion(lists, weights={"vector": 3, "lexical": 1}, by=("query_id",)).select("query_id", "id", F.round("score", 9).alias("score"))


@R.frame("R20_relevant_communities", "WITH v AS (SELECT s_nationkey AS query_id, s_suppkey AS id FROM supplier WHERE s_acctbal > 8000), t AS (SELECT c_nationkey AS query_id, c_custkey AS id FROM customer WHERE c_acctbal > 9500), f AS (SELECT n_nationkey AS query_id, n_regionkey AS id FROM nation) SELECT query_id, CAST(id AS BIGINT) AS id, 1 AS tier FROM v UNION ALL SELECT query_id, id, 2 FROM t WHERE query_id NOT IN (SELECT query_id FROM v) UNION ALL SELECT query_id, id, 3 FROM f WHERE query_id NOT IN (SELECT query_id FROM v) AND query_id NOT IN (SELECT query_id FROM t)")
def r20(spark, d):
    v = table(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("id"))
    t = table(spark, d, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("id"))
    f = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_regionkey").cast("long").alias("id"))
    return context.first_tier(v, t, f)


@R.frame("X13_chinese_ratio", "SELECT doc_id, CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '[\\x{4e00}-\\x{9fff}]', '', 'g'))) / length(text) ELSE 0 END::DOUBLE AS share FROM documents")
def x13(spark, d):
    return table(spark, d, "documents").select("doc_id", entities.chinese_ratio("text").alias("share"))


@R.frame("X35_jaccard", "SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END, 9)::DOUBLE AS same FROM (SELECT conv_id, turn, string_split(lower(coalesce(text, '')), ' ') AS w FROM conversations) a JOIN (SELECT conv_id, turn, string_split(lower(coalesce(text, '')), ' ') AS w FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def x35(spark, d):
    w = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.lower(F.coalesce("text", F.lit(""))), " ").alias("w"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(C.jaccard(F.col("w"), F.col("v")), 9).alias("same"))
