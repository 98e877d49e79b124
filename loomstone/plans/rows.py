"""The relational plans as calls of operators; their SQL in relational.py is written apart, for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import communities, reading, usage
from ..sources import tables
from . import relational
from .registry import table

QUERIES: dict = {}
SQL: dict = {}


def _k():
    """The number in an event's properties."""
    return F.get_json_object("props", "$.k").cast("long")


def plan(name: str):
    """Registers the Spark side of a plan whose SQL relational.py has."""
    if name not in relational.SQL:
        raise KeyError(name)

    def add(f):
        QUERIES[name] = f
        SQL[name] = relational.SQL[name]
        return f

    return add


T = table
plan("S1_source_scan")(lambda s, d: T(s, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name", "s_acctbal").orderBy("s_name", "s_suppkey"))
plan("S8_incremental_read")(lambda s, d: reading.page(tables.read_since(T(s, d, "orders"), "o_orderkey", 1000), ["o_orderkey"], 500).select("o_orderkey", "o_custkey", "o_totalprice"))
plan("S10_offset_read")(lambda s, d: reading.page(T(s, d, "orders"), ["o_orderkey"], 100, 200).select("o_orderkey", "o_orderstatus"))
plan("S16_labelled_scan")(lambda s, d: reading.label_rows({"nation": T(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), "region": T(s, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))}, "label"))
plan("F1_list_filter")(lambda s, d: reading.where_all(T(s, d, "orders"), {"o_orderstatus": "O"}, {"o_custkey": 500}, {"o_totalprice": 1000}).select("o_orderkey", "o_totalprice"))
plan("F2_point_lookup")(lambda s, d: reading.where_all(T(s, d, "customer"), {"c_custkey": 42}))
plan("F3_existing_membership")(lambda s, d: reading.existing(T(s, d, "orders"), T(s, d, "customer").where("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey").select("o_orderkey"))
plan("F4_pending_scan")(lambda s, d: reading.in_state(T(s, d, "orders"), "o_orderstatus", "P", ["o_orderdate", "o_orderkey"], 50).select("o_orderkey", "o_orderdate"))
plan("F5_stuck_rows")(lambda s, d: reading.in_state(reading.older_than(T(s, d, "orders"), "o_orderdate", "30 DAYS"), "o_orderstatus", "O").select("o_orderkey"))
plan("F11_stale_pending")(lambda s, d: reading.in_state(reading.older_than(T(s, d, "orders"), "o_orderdate", "1 DAY"), "o_orderstatus", "P").select("o_orderkey"))
plan("F7_failed_retryable")(lambda s, d: T(s, d, "events").where((F.col("event_type") == "error") & (_k() < 50)).select("event_id", "user_id"))
plan("F8_usage_filter")(lambda s, d: reading.page(reading.where_all(T(s, d, "events"), {"event_type": "view"}, {"user_id": 100}), [F.desc("ts"), F.desc("event_id")], 200).select("event_id", "ts", "value"))
plan("F9_failure_filter")(lambda s, d: reading.page(reading.where_all(T(s, d, "events"), {"event_type": "error"}), [F.desc("ts"), F.desc("event_id")], 200).select("event_id", "ts"))
plan("F10_needs_review")(lambda s, d: reading.where_all(T(s, d, "supplier"), below={"s_acctbal": 0}).select("s_suppkey", "s_name"))
plan("F13_entity_text_search")(lambda s, d: reading.text_search(T(s, d, "part"), {"p_name": "ring", "p_type": "small"}).select("p_partkey", "p_name"))
plan("F15_names_in_list")(lambda s, d: T(s, d, "nation").where(F.col("n_name").isin("FRANCE", "GERMANY", "NATION_3", "NATION_7")).select("n_nationkey", "n_name"))
plan("F16_community_text_search")(lambda s, d: reading.text_search(T(s, d, "region"), {"r_name": "a"}).select("r_regionkey", "r_name").orderBy("r_regionkey"))
plan("F20_events_by_range")(lambda s, d: reading.page(reading.from_first(T(s, d, "events"), "ts", "24 HOURS"), ["ts", "event_id"], 500).select("event_id", "ts"))
plan("F21_orphans")(lambda s, d: reading.missing(T(s, d, "part"), T(s, d, "lineitem").where("l_quantity > 40"), "p_partkey", "l_partkey").select("p_partkey"))
plan("F22_tolerant_prune")(lambda s, d: reading.not_pruned(T(s, d, "documents").join(T(s, d, "labels"), "doc_id", "left"), "toxic").select("doc_id"))
plan("F23_strict_prune")(lambda s, d: reading.not_pruned(T(s, d, "documents").join(T(s, d, "labels"), "doc_id", "left"), "toxic", strict=True).select("doc_id"))
plan("J1_vector_article_join")(lambda s, d: T(s, d, "embeddings").join(T(s, d, "documents"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "label", "source", "lang"))
plan("J4_anti_join")(lambda s, d: reading.missing(T(s, d, "customer"), T(s, d, "orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey").select("c_custkey"))
plan("J5_set_difference")(lambda s, d: T(s, d, "documents").select("doc_id").subtract(T(s, d, "labels").select("doc_id")))
plan("J8_unassigned_count")(lambda s, d: reading.missing(T(s, d, "part"), T(s, d, "lineitem").where("l_discount > 0.08"), "p_partkey", "l_partkey").agg(F.count(F.lit(1)).alias("unassigned")))
plan("J10_dangling_parent")(lambda s, d: reading.missing(T(s, d, "nation").where("n_regionkey IS NOT NULL"), T(s, d, "region").where("r_regionkey <> 2"), "n_regionkey", "r_regionkey").select("n_nationkey"))
plan("J11_member_counts")(lambda s, d: usage.degrees_of(T(s, d, "region"), "r_regionkey", T(s, d, "nation"), "n_regionkey", members="n_nationkey"))
plan("J14_entity_articles")(lambda s, d: T(s, d, "lineitem").where(F.col("l_partkey").isin(1, 2, 3)).join(T(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_partkey", "o_orderkey", "o_orderdate").distinct())
plan("J15_article_entities")(lambda s, d: T(s, d, "lineitem").join(T(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "p_partkey", "p_name", "l_returnflag").distinct())
plan("J20_touching_edges")(lambda s, d: T(s, d, "lineitem").where(F.col("l_partkey").isin(1, 5, 9) | F.col("l_suppkey").isin(2, 4)).select("l_orderkey", "l_linenumber"))
plan("J22_members")(lambda s, d: T(s, d, "region").join(T(s, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name"))
plan("A1_global_summary")(lambda s, d: usage.summary(T(s, d, "events"), [], tokens=F.sum(_k()), least=F.min("value"), most=F.max("value"), ok=F.sum((F.col("event_type") != "error").cast("long"))))
plan("A3_by_provider")(lambda s, d: usage.summary(T(s, d, "events"), ["user_id"], tokens=F.sum(_k())).orderBy(F.desc("tokens"), "user_id"))
plan("A4_by_model")(lambda s, d: usage.summary(T(s, d, "events"), ["user_id", "event_type"], slowest=F.max("value")))
plan("A5_by_call_point")(lambda s, d: usage.summary(T(s, d, "events"), ["event_type"], mean=F.round(F.avg("value"), 6)))
plan("A6_hourly_rollup")(lambda s, d: usage.rollup_by_time(T(s, d, "events"), "ts", "hour", ["event_type"], valued=F.count("value"), least=F.min("value"), most=F.max("value")))
plan("A6_daily_rollup")(lambda s, d: usage.rollup_by_time(T(s, d, "events"), "ts", "day", ["event_type"], least=F.min("value"), most=F.max("value")))
plan("A6_monthly_rollup")(lambda s, d: usage.rollup_by_time(T(s, d, "events"), "ts", "month", tokens=F.sum(_k())))
plan("A8_latency_bounds")(lambda s, d: usage.rollup_by_time(T(s, d, "events"), "ts", "hour", least=F.min("value"), most=F.max("value")).drop("calls"))
plan("A10_counter_pivot")(lambda s, d: usage.pivot_counts(T(s, d, "events"), "user_id", "event_type", {"click": "click", "error": "error", "purchase": "purchase", "signup": "signup", "view": "viewed"}))
plan("A13_failure_stats")(lambda s, d: usage.failure_stats(T(s, d, "events").where(F.col("event_type").isin("error", "click")), "user_id", "event_type", "ts"))
plan("A15_queue_stats")(lambda s, d: T(s, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")))
plan("A16_status_histogram")(lambda s, d: usage.state_histogram(T(s, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"]))
plan("A14_task_progress")(lambda s, d: usage.pivot_counts(T(s, d, "orders"), "o_custkey", "o_orderstatus", {"F": "done", "O": "working", "P": "pending"}).join(T(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total")), "o_custkey"))
plan("A17_source_auto_score")(lambda s, d: T(s, d, "supplier").where("s_acctbal IS NOT NULL").groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 6).alias("score")))
plan("A20_graph_counts")(lambda s, d: usage.table_counts({"entities": T(s, d, "part"), "articles": T(s, d, "orders"), "mentions": T(s, d, "lineitem")}))
plan("A21_degrees")(lambda s, d: usage.degrees_of(T(s, d, "part"), "p_partkey", T(s, d, "lineitem"), "l_partkey", outgoing="l_suppkey", incoming="l_orderkey"))
plan("A24_high_degree")(lambda s, d: usage.top_by_count(T(s, d, "lineitem"), "l_partkey", 100, least=30))
plan("A25_type_distribution")(lambda s, d: usage.top_by_count(T(s, d, "part"), "p_type", 20, "n"))
plan("A26_level_distribution")(lambda s, d: T(s, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")))
plan("A29_relation_types")(lambda s, d: T(s, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("targets")))
plan("A31_edge_collapse")(lambda s, d: T(s, d, "lineitem").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.max("l_quantity").alias("weight")))
plan("A34_provider_metrics")(lambda s, d: usage.share_of(T(s, d, "events"), "user_id", F.col("event_type") == "error", "failure_rate"))
plan("A35_risk_max")(lambda s, d: T(s, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)).alias("risk")))
plan("W3_keep_latest")(lambda s, d: reading.keep_latest(T(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate"))
plan("W5_event_neighbours")(lambda s, d: reading.surroundings(T(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_id"))
plan("W8_prefix_budget")(lambda s, d: reading.running(T(s, d, "conversations"), ["conv_id"], ["turn"], F.length("text") / 4.0, "used").where("used <= 400").select("conv_id", "turn"))
plan("W10_percentiles")(lambda s, d: T(s, d, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95")))
plan("K1_paged_sort")(lambda s, d: reading.page(T(s, d, "orders"), [F.desc_nulls_last("o_totalprice"), "o_orderkey"], 20, 40).select("o_orderkey", "o_totalprice"))
plan("K4_community_paging")(lambda s, d: reading.page(T(s, d, "nation"), ["n_regionkey", F.desc("n_nationkey")], 10, 5).select("n_nationkey", "n_regionkey"))
plan("K5_chain_paging")(lambda s, d: reading.page(T(s, d, "events"), ["ts", "event_id"], 50, 100).select("event_id", "ts"))
plan("U1_union_all_types")(lambda s, d: reading.label_rows({k: T(s, d, "lineitem").where(F.col("l_returnflag") == k).select(F.col("l_orderkey").alias("k")) for k in ("A", "R")}))
plan("U3_concat_kinds")(lambda s, d: reading.label_rows({n: reading.in_state(T(s, d, "orders"), "o_orderstatus", v).select("o_orderkey") for n, v in (("pending", "P"), ("open", "O"))}))
plan("U4_difference")(lambda s, d: T(s, d, "lineitem").select("l_suppkey").subtract(T(s, d, "supplier").where("s_acctbal < 5000").select("s_suppkey")))
plan("U4_intersection")(lambda s, d: T(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey").intersect(T(s, d, "orders").where("o_orderstatus = 'P'").select("o_custkey")))
plan("U6_distinct")(lambda s, d: T(s, d, "documents").select("source", "lang").distinct())
plan("P13_upsert")(lambda s, d: reading.keep_latest(T(s, d, "orders").where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey", "o_orderdate"], ["o_orderkey"]).drop("o_orderdate"))
plan("P25_purge")(lambda s, d: reading.within_last(T(s, d, "events"), "ts", "2 DAYS").select("event_id"))


@plan("F6_incomplete_rows")
def incomplete(s, d):
    flag = T(s, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_returnflag").alias("flag"))
    done = reading.in_state(T(s, d, "orders"), "o_orderstatus", "F")
    return done.join(flag, "o_orderkey", "left").where("flag IS NULL OR o_orderpriority IS NULL").select("o_orderkey")


@plan("J13_co_mention")
def co_mention(s, d):
    li = T(s, d, "lineitem")
    return reading.existing(li, li.where("l_partkey = 7").select("l_orderkey"), "l_orderkey", "l_orderkey").where("l_partkey <> 7").select(F.col("l_partkey").alias("other")).distinct()


@plan("J17_related_articles")
def related_articles(s, d):
    o = reading.existing(T(s, d, "orders"), T(s, d, "lineitem").where("l_suppkey = 3"), "o_orderkey", "l_orderkey")
    return reading.page(o, [F.desc("o_orderdate"), "o_orderkey"], 10).select("o_orderkey", "o_orderdate")


@plan("J18_typed_neighbours")
def typed_neighbours(s, d):
    li = T(s, d, "lineitem").where("l_partkey = 5")
    side = lambda c, name: li.groupBy(F.col(c).alias("other")).agg(F.count(F.lit(1)).alias("weight")).select("other", F.lit(name).alias("direction"), "weight")
    return side("l_suppkey", "out").unionByName(side("l_orderkey", "in"))


@plan("J23_key_entities")
def key_entities(s, d):
    n = usage.degrees_of(T(s, d, "nation"), "n_nationkey", T(s, d, "supplier"), "s_nationkey", degree="s_suppkey").join(T(s, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    return reading.page(n, [F.desc("degree"), "n_nationkey"], 10).select("n_regionkey", "n_nationkey", "degree")


def _ends(s, d):
    """Line items with the region of their customer (c1) and of their supplier (c2)."""
    nation = T(s, d, "nation")
    customer = T(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_regionkey")
    supplier = T(s, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey")
    edges = T(s, d, "lineitem").join(T(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", "l_suppkey")
    return usage.two_ends(edges, (customer, "o_custkey", "n_regionkey"), (supplier, "l_suppkey", "n_regionkey"))


plan("J24_cross_community")(lambda s, d: _ends(s, d).where("c1 <> c2").select("c1", "c2", "l_suppkey").distinct())


@plan("J29_top_degree_snapshot")
def top_degree(s, d):
    top = usage.top_by_count(T(s, d, "lineitem"), "l_partkey", 20)
    return T(s, d, "lineitem").join(F.broadcast(top), "l_partkey").select("l_orderkey", "l_partkey", "degree")  # twenty rows


@plan("J26_affected_communities")
def affected_communities(s, d):
    suppliers = reading.existing(T(s, d, "supplier"), T(s, d, "lineitem").where("l_partkey = 11"), "s_suppkey", "l_suppkey")
    return reading.existing(T(s, d, "nation"), suppliers, "n_nationkey", "s_nationkey").select("n_regionkey").distinct()


@plan("W1_list_rank")
def list_rank(s, d):
    w = Window.partitionBy("l_returnflag", "l_linestatus", "l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return T(s, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))


@plan("M2_temporal_chain")
def temporal_chain(s, d):
    e = T(s, d, "events")
    return reading.surroundings(e, ["user_id"], ["ts", "event_id"], "event_id", 1).join(e.select("event_id", "user_id"), "event_id").select("user_id", "event_id", F.col("after1").alias("followed_by"))


@plan("P16_fill_if_null")
def fill_if_null(s, d):
    both = T(s, d, "documents").select("doc_id").join(T(s, d, "labels"), "doc_id", "left")
    return both.select("doc_id", F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@plan("P23_consistency")
def consistency(s, d):
    docs, labels = T(s, d, "documents"), T(s, d, "labels")
    return usage.table_counts({"documents": docs, "labelled": labels, "lost": reading.missing(labels, docs, "doc_id", "doc_id")})


@plan("S28_index_scan")
def index_scan(s, d):
    found = reading.index_scan(T(s, d, "documents"), "text", "source", ["src0", "src1", "src2"])
    return found.select("doc_id", "source", F.length("text").cast("long").alias("n"))


@plan("A2_errors_by_type")
def errors_by_type(s, d):
    return usage.errors_by_type(T(s, d, "events"), "event_type", _k() > 10)


@plan("A19_filtered_count")
def filtered_count(s, d):
    return usage.page_count(reading.in_state(T(s, d, "orders"), "o_orderstatus", "O"))


@plan("A22_average_degree")
def average_degree(s, d):
    return usage.mean_degree(T(s, d, "part"), "p_partkey", T(s, d, "lineitem"), "l_partkey").select(F.round("mean", 9).alias("mean"))


@plan("A27_community_metrics")
def community_metrics(s, d):
    return usage.group_sizes(T(s, d, "nation"), "n_regionkey").withColumn("mean_size", F.round("mean_size", 6))


@plan("A32_count_aggregate")
def count_aggregate(s, d):
    return usage.counted_sure(T(s, d, "events"), "user_id")


@plan("W9_drop_over_three")
def drop_over_three(s, d):
    return usage.dropped_over(T(s, d, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "dropped")


@plan("K9_stable_sections")
def stable_sections(s, d):
    return reading.by_sections(T(s, d, "conversations"), "role", ["system", "user"], ["conv_id", "turn"]).select("conv_id", "turn", "role")


@plan("J25_intra_community")
def intra_community(s, d):
    c = T(s, d, "customer").join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("rc"))
    sup = T(s, d, "supplier").join(T(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("rs"))
    o = T(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "rc")
    li = T(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    return communities.inner_links(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "rs", "rc", "l_suppkey", 30)


@plan("J16_triangles")
def mention_triangles(s, d):
    li = T(s, d, "lineitem")
    return communities.mention_triangles(li, li, "l_orderkey", "l_partkey", "l_orderkey", "l_suppkey")
