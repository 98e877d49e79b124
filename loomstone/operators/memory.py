"""Causes, effects and guided walks over graphs of events, and texts packed into a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.tables import tasks_for, written

CAUSAL_FROM = 0.7
# Weight of an edge's kind under an intent, in the order causal, temporal, entity, semantic.
KINDS = ("causal", "temporal", "entity", "semantic")
INTENTS = {"why": (5.0, 2.0, 1.5, 0.5), "when": (1.0, 5.0, 2.0, 1.0), "entity": (1.0, 1.0, 5.0, 3.0), "open": (1.5, 1.0, 2.0, 4.0)}


def merge_causes(edges: DataFrame, order: str = "seen") -> DataFrame:
    """(src, dst, type, confidence, evidence): edges of at least CAUSAL_FROM; greatest confidence, last evidence that is not null."""
    return edges.where(F.col("confidence") >= CAUSAL_FROM).groupBy("src", "dst", "type").agg(
        F.max("confidence").alias("confidence"), F.max_by("evidence", F.when(F.col("evidence").isNotNull(), F.struct(order, "evidence"))).alias("evidence"))


def causal_chain(edges: DataFrame, events: DataFrame, depth: int, types: tuple[str, ...] = ("CAUSES", "ENABLES")) -> DataFrame:
    """(event, node, distance): what leads to each event in 1 to depth steps, each node once, at its least distance.

    A level of the walk is one join of the frontier with the edges; nodes that were met before are not followed again. An event is
    no cause of itself.
    """
    back = edges.where(F.col("type").isin(*types)).select("src", "dst").distinct()
    seen = front = events.select(F.col("event"), F.col("event").alias("node")).distinct().withColumn("distance", F.lit(0))
    for k in range(1, depth + 1):
        next_ = front.select("event", F.col("node").alias("dst")).join(back, "dst").select("event", F.col("src").alias("node")).distinct()
        front = written(next_.join(seen.select("event", "node"), ["event", "node"], "left_anti").withColumn("distance", F.lit(k)))
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def near_causes(edges: DataFrame, events: DataFrame, effects: bool = False) -> DataFrame:
    """(event, node, type, confidence) one step back (or on), what prevents left out."""
    here, there = ("src", "dst") if effects else ("dst", "src")
    return edges.where("type <> 'PREVENTS'").join(events.select(F.col("event").alias(here)).distinct(), here).select(F.col(here).alias("event"), F.col(there).alias("node"), "type", "confidence")


def transition(intent, kind, similarity) -> Column:
    """exp(weight of the kind under the intent + similarity / 2); an unknown intent is open, an unknown kind weighs 0."""
    weights = F.create_map(*[F.lit(x) for i, ws in INTENTS.items() for k, w in zip(KINDS, ws) for x in (f"{i} {k}", w)])
    asked = F.when(col(intent).isin(*INTENTS), col(intent)).otherwise("open")
    return F.exp(F.coalesce(F.element_at(weights, F.concat_ws(" ", asked, col(kind))), F.lit(0.0)) + 0.5 * col(similarity))


def beam_search(edges: DataFrame, anchors: DataFrame, depth: int = 5, width: int = 10, fade: float = 0.9) -> DataFrame:
    """(query, node, score, depth): the walk of a beam from each query's anchors.

    edges (src, dst, kind[, similarity]); anchors (query, intent, node). Each level joins the beam with the edges, scores
    score * fade + transition, drops nodes that the query has met, and keeps the width best of each query. One job a level for all queries.
    """
    if "similarity" not in edges.columns:
        edges = edges.withColumn("similarity", F.lit(0.0))
    beam = anchors.select("query", "intent", "node").distinct().withColumn("score", F.lit(0.0)).withColumn("depth", F.lit(0))
    seen = beam
    best = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "node")
    for k in range(1, depth + 1):
        step = beam.join(edges.select(F.col("src").alias("node"), "dst", "kind", "similarity"), "node").withColumn("next", F.col("score") * fade + transition("intent", "kind", "similarity"))
        level = step.groupBy("query", "intent", F.col("dst").alias("node")).agg(F.max("next").alias("score")).join(seen.select("query", "node"), ["query", "node"], "left_anti")
        beam = written(level.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= width).drop("__r").withColumn("depth", F.lit(k)))
        if not beam.take(1):
            break
        seen = seen.unionByName(beam.select(*seen.columns))
    return seen.select("query", "node", "score", "depth")


def pack_context(rows: DataFrame, budget: int, by: str = "query", order: str = "score", item: str = "node", text: str = "text") -> DataFrame:
    """(by, context, used, kept, dropped): texts in falling order up to a budget of tokens (a quarter of the characters each).

    Texts are taken while the running sum fits; from the first that does not, all are dropped and listed.
    """
    w = Window.partitionBy(by).orderBy(F.desc(order), item)
    size = F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("long")
    put = rows.withColumn("__n", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__r", F.row_number().over(w))
    fits = F.col("__n") <= budget
    kept = F.array_sort(F.collect_list(F.when(fits, F.struct(F.col("__r").alias("r"), F.col(item).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")))))
    gone = F.array_sort(F.collect_list(F.when(~fits, F.struct(F.col("__r").alias("r"), F.col(item).alias("i")))))
    packed = put.groupBy(by).agg(kept.alias("k"), gone.alias("g"), F.coalesce(F.max(F.when(fits, F.col("__n"))), F.lit(0)).alias("used"))
    return packed.select(by, F.array_join(F.col("k.t"), "\n").alias("context"), "used", F.col("k.i").alias("kept"), F.col("g.i").alias("dropped"))


def to_events(rows: DataFrame, key: str, title: str, body: str, at: str, now: Column, attributes: dict[str, str], vector: str | None = None) -> DataFrame:
    """(id, content, timestamp, embedding, attributes) of processed rows: title and body with an empty line between, the publish time or
    now, and the attributes (name to column) that are there."""
    t, b = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(body), F.lit(""))
    content = F.when((t != "") & (b != ""), F.concat(t, F.lit("\n\n"), b)).otherwise(F.concat(t, b))
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(c).cast("string").alias("value")) for n, c in attributes.items()])
    known = F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))
    return rows.select(F.col(key).cast("string").alias("id"), content.alias("content"), F.coalesce(F.col(at), now).alias("timestamp"), (F.col(vector) if vector else F.lit(None)).alias("embedding"), known.alias("attributes"))


def append_chain(events: DataFrame, new: DataFrame, key: str = "event_id", at: str = "ts", by: str | None = None, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, edges (src, dst, hours)): the chain after new events; an id that is there is left alone. Each event is followed by the next
    in time, ties by id; `by` makes a chain for each of its values, which keeps any one chain's sort bounded. rows: how many both have, at
    most; tasks are then of bounded size."""
    dealt = lambda df, c: df if rows is None else df.repartition(tasks_for(rows), c)
    fresh = dealt(new, key).dropDuplicates([key]).join(dealt(events.select(key), key), key, "left_anti")
    every = events.unionByName(fresh.select(*events.columns))
    every = dealt(every, by) if by else every
    w = Window.partitionBy(*([by] if by else [])).orderBy(at, key)
    hours = (F.unix_micros(F.lead(at).over(w).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 3.6e9
    return every, every.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst"), hours.alias("hours")).where("dst IS NOT NULL")


def ingest(events: DataFrame, new: DataFrame, mentions: DataFrame, key: str = "event_id", at: str = "ts", by: str | None = None) -> dict[str, DataFrame]:
    """The fast path of a batch: events and chain after it, links (event, entity) of its mentions, and the queue of what to consolidate."""
    every, chain = append_chain(events, new, key, at, by)
    fresh = new.dropDuplicates([key]).join(events.select(key), key, "left_anti")
    links = mentions.join(fresh.select(key), key).select(F.col(key).alias("event"), "entity").distinct()
    return {"events": every, "chain": chain, "links": links, "queue": fresh.select(F.col(key).alias("event"), F.col(at).alias("at"))}


def around(events: DataFrame, reach: int = 2, key: str = "event_id", at: str = "ts", by: str = "user_id") -> DataFrame:
    """(center, other, step): events up to `reach` places before (negative) and after each event of a chain."""
    w = Window.partitionBy(by).orderBy(at, key)
    steps = [k for k in range(-reach, reach + 1) if k]
    wide = events.select(F.col(key).alias("center"), *[(F.lead(key, k) if k > 0 else F.lag(key, -k)).over(w).alias(f"__{i}") for i, k in enumerate(steps)])
    others = F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"__{i}").alias("other")) for i, k in enumerate(steps)])
    return wide.select("center", F.explode(F.filter(others, lambda o: o["other"].isNotNull())).alias("o")).select("center", "o.other", "o.step")


def consolidate(queue: DataFrame, near: DataFrame, confidence: Column, kind: Column, batch: int | None = None, least: float = CAUSAL_FROM) -> DataFrame:
    """(src, dst, type, confidence): causal edges from queued events to what is around them, as the caller's Columns over near's rows judge
    them (a model's reply or a rule), those of at least `least`. batch: only the oldest so many of the queue."""
    mine = queue.select(F.col("event").alias("center"), "at")
    if batch is not None:
        mine = mine.orderBy("at", "center").limit(batch)
    judged = near.join(mine.select("center"), "center").select(F.col("center").alias("src"), F.col("other").alias("dst"), kind.alias("type"), confidence.alias("confidence"))
    return judged.where(F.col("confidence") >= least).groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def anchors(events: DataFrame, questions: DataFrame, key: str = "event_id", at: str = "ts") -> DataFrame:
    """(query, intent, node): where a question's walk begins: the first five events in time for why, else the first three."""
    first = events.orderBy(at, key).limit(5).select(F.col(key).alias("node"), F.row_number().over(Window.orderBy(at, key)).alias("__r"))  # five rows
    return questions.join(F.broadcast(first)).where(F.col("__r") <= F.when(F.col("intent") == "why", 5).otherwise(3)).select("query", "intent", "node")


def neighbours_by_intent(asked: DataFrame, chain: DataFrame, causes: DataFrame) -> DataFrame:
    """(event, node, kind): what an asked event (event, intent) leads to: both sides of its chain edges; for why causes and effects too."""
    ends = lambda e, kind: e.select(F.col("src").alias("event"), F.col("dst").alias("node"), F.lit(kind).alias("kind")).unionByName(e.select(F.col("dst").alias("event"), F.col("src").alias("node"), F.lit(kind).alias("kind")))
    timed = ends(chain, "temporal").join(asked.select("event"), "event")
    return timed.unionByName(ends(causes, "causal").join(asked.where("intent = 'why'").select("event"), "event")).distinct()


def timeline(mentions: DataFrame, most: int = 10, chars: int = 100, by: str = "entity", at: str = "at", text: str = "text") -> DataFrame:
    """(by, facts, count, confidence): an entity's first `most` events with a time, as "[time] text"; confidence grows to 1 at five events."""
    timed = mentions.where(F.col(at).isNotNull())
    fact = F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.substring(F.coalesce(F.col(text), F.lit("")), 1, chars))
    w = Window.partitionBy(by).orderBy(at, text)
    first = timed.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__r").alias("r"), fact.alias("f")))), lambda x: x["f"]).alias("facts"))
    return timed.groupBy(by).agg(F.count(F.lit(1)).alias("count")).join(first, by).select(by, "facts", "count", F.least(F.lit(1.0), F.col("count") / 5).alias("confidence"))


def entity_aggregate(mentions: DataFrame, kind: str, by: str = "entity", at: str = "at", text: str = "text") -> DataFrame:
    """(by, count, confidence[, facts]) by kind: "count" (sure at ten events) or "timeline"; "facts" gives the texts for a caller's model."""
    if kind == "timeline":
        return timeline(mentions, by=by, at=at, text=text)
    n = mentions.groupBy(by).agg(F.count(F.lit(1)).alias("count")).withColumn("confidence", F.least(F.lit(1.0), F.col("count") / 10))
    if kind == "count":
        return n
    if kind != "facts":
        raise ValueError(f"unknown aggregate {kind}")
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last(at), text)
    last = mentions.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 20)
    return n.join(last.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__r").alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"]).alias("facts")), by)


def temporal_search(events: DataFrame, limit: int, days: int, key: str = "event_id", at: str = "ts") -> DataFrame:
    """The first `limit` events, in time, of the window of `days` that ends with the last event."""
    last = events.agg(F.max(at).alias("__last"))
    return events.join(F.broadcast(last)).where(F.col(at) >= F.col("__last") - F.expr(f"INTERVAL {days} DAYS")).drop("__last").orderBy(at, key).limit(limit)
