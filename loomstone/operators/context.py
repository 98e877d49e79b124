"""Hybrid search, contexts for answers, and the confidence of answers. Models that write or rank texts are the caller's: a Column or a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, tokens
from . import retrieval

# Weight of source, content and timeliness by category; all others weigh as the last.
CREDIBILITY = {"政治": (0.25, 0.25, 0.50), "国际": (0.25, 0.25, 0.50), "军事": (0.25, 0.25, 0.50), "经济": (0.45, 0.35, 0.20), "科技": (0.30, 0.50, 0.20), None: (0.40, 0.40, 0.20)}


def keyword_rescore(hits: DataFrame, query: str = "query", text: str = "text", similarity: str = "similarity", vector_share: float = 0.7) -> DataFrame:
    """hits with `score`: vector_share of the similarity, the rest for the share of query words that the text contains."""
    words = tokens(F.coalesce(F.col(query), F.lit("")))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.size(F.filter(words, lambda w: F.contains(low, w))) / F.greatest(F.size(words), F.lit(1))
    return hits.withColumn("score", vector_share * F.col(similarity) + (1 - vector_share) * found)


def fusion_quality(fused: DataFrame, lists: DataFrame, k: int = 10, by: str = "query_id", item: str = "id") -> DataFrame:
    """(by, filled, distinct_items, fused): share of k places filled, distinct items over the lists, items after fusion."""
    n = fused.groupBy(by).agg(F.count(F.lit(1)).alias("fused"))
    return lists.groupBy(by).agg(F.countDistinct(item).alias("distinct_items")).join(n, by, "left").select(by, (F.least(F.coalesce("fused", F.lit(0)), F.lit(k)) / k).alias("filled"), "distinct_items", F.coalesce("fused", F.lit(0)).alias("fused"))


def hybrid_search(lexical: DataFrame, nearest: DataFrame, texts: DataFrame, limit: int, age: str | None = None, half_life: float = 30.0, diverse: float | None = None, rerank: Column | None = None) -> DataFrame:
    """(query_id, id, score, place): both lists cut at 2 * limit, fused by rank, re-scored, decayed, made diverse, cut.

    lexical and nearest (query_id, id, rank); texts (id, text[, age column]). rerank: a Column over score and text that replaces the fused score.
    A document without a time does not decay.
    """
    lists = lexical.where(F.col("rank") <= 2 * limit).select("query_id", "id", "rank", F.lit("lexical").alias("list")).unionByName(nearest.where(F.col("rank") <= 2 * limit).select("query_id", "id", "rank", F.lit("vector").alias("list")))
    fused = retrieval.reciprocal_rank_fusion(lists, by=("query_id",)).select("query_id", "id", "score").join(texts, "id")
    if rerank is not None:
        fused = fused.withColumn("score", rerank)
    if age:
        fused = retrieval.with_decay(fused, age, half_life)
    if diverse is not None:
        return retrieval.mmr(fused, limit, diverse, most=4 * limit)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return fused.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query_id", "id", "score", "place")


def first_tier(*tiers: DataFrame, by: str = "query_id") -> DataFrame:
    """Per query the rows of the first tier that has any, with `tier` counted from 1: vector hits, else text hits, else a fallback."""
    every = None
    for k, t in enumerate(tiers, 1):
        t = t.withColumn("tier", F.lit(k))
        every = t if every is None else every.unionByName(t)
    return every.withColumn("__first", F.min("tier").over(Window.partitionBy(by))).where("tier = __first").drop("__first")


def local_context(entities: DataFrame, relations: DataFrame, mentions: DataFrame, most: int = 20, told: Column | None = None) -> DataFrame:
    """(query, section, item, place): what is told about a query's entities, in sections entities, relations and articles.

    entities (query, entity); relations (src, dst, type, weight); mentions (article, entity, at). Each section keeps its `most` best: relations by
    weight, articles by how many of the entities they mention, then the newest. A node of one kind must not have the number of one of another:
    give them numbers apart, and as `told` the text of a relation over src, type and dst, where it shows others.
    """
    asked = entities.select("query", "entity").distinct()
    ends = relations.select(F.col("src").alias("entity"), "src", "dst", "type", "weight").unionByName(relations.select(F.col("dst").alias("entity"), "src", "dst", "type", "weight"))
    links = ends.join(asked, "entity").select("query", "src", "dst", "type", "weight").distinct().select("query", F.lit("relations").alias("section"), (F.concat_ws(" ", "src", "type", "dst") if told is None else told).alias("item"), F.col("weight").cast("double").alias("s"), F.lit(0).cast("long").alias("t"))
    articles = mentions.select("article", "entity", "at").distinct().join(asked, "entity").groupBy("query", "article").agg(F.countDistinct("entity").cast("double").alias("s"), F.unix_micros(F.max("at").cast("timestamp")).alias("t"))
    rows = asked.select("query", F.lit("entities").alias("section"), F.col("entity").cast("string").alias("item"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("t")).unionByName(links).unionByName(articles.select("query", F.lit("articles").alias("section"), F.col("article").cast("string").alias("item"), "s", "t"))
    w = Window.partitionBy("query", "section").orderBy(F.desc("s"), F.desc("t"), "item")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query", "section", "item", "place")


def local_confidence(sections, entities, relations, n_tokens) -> Column:
    raw = 0.5 + F.least(F.lit(0.2), 0.02 * col(entities)) + F.least(F.lit(0.2), 0.01 * col(relations)) - F.when(col(n_tokens) < 500, 0.2).otherwise(0.0)
    return F.when(col(sections) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def global_confidence(answers, chars, empty) -> Column:
    """Of an answer made of several: enough of them, long enough, none empty."""
    length = F.when(col(chars) > 500, 0.2).when(col(chars) > 200, 0.1).otherwise(0.0)
    return 0.5 + F.when(col(answers) >= 3, 0.1).otherwise(0.0) + length + F.when(col(empty) == 0, 0.1).otherwise(0.0)


def simple_confidence(communities, n_tokens) -> Column:
    return 0.4 + F.when(col(communities) >= 3, 0.2).when(col(communities) >= 1, 0.1).otherwise(0.0) + F.when(col(n_tokens) > 1000, 0.2).otherwise(0.0)


def intent(question) -> Column:
    """why, when, entity, multi_hop or open, by the words of a question; a caller's model may give the label instead."""
    q = F.lower(F.coalesce(col(question), F.lit("")))
    return F.when(q.rlike(r"\b(why|cause[sd]?|because|reason)\b|为什么|原因"), "why").when(q.rlike(r"\b(when|date|year|before|after)\b|何时|什么时候"), "when").when(q.rlike(r"\b(relat\w+|between|through)\b|关系|之间"), "multi_hop").when(q.rlike(r"\b(who|what|which|where)\b|谁|哪"), "entity").otherwise("open")


def route(label) -> Column:
    return F.when(col(label).isin("why", "when", "entity"), "local").otherwise("global")


def credibility(category, source, content, timeliness) -> Column:
    """Weighted sum to two digits by category; a missing source or content score is .5."""
    out = None
    for name, (s, c, t) in CREDIBILITY.items():
        total = F.round(s * F.coalesce(col(source), F.lit(0.5)) + c * F.coalesce(col(content), F.lit(0.5)) + t * col(timeliness), 2)
        out = F.when(col(category) == name, total) if out is None else out.when(col(category) == name, total) if name else out.otherwise(total)
    return out


def retry_batch(size, success_rate, least: int = 5, most: int = 50) -> Column:
    """Twice the batch while four of five succeed, else half of it."""
    return F.when(col(success_rate) >= 0.8, F.least(col(size) * 2, F.lit(most))).otherwise(F.greatest(F.floor(col(size) / 2), F.lit(least))).cast("long")


# Which states may follow a state; any may follow itself.
STATES = {"pending": ("processing", "failed"), "processing": ("pg_done", "failed"), "pg_done": ("neo4j_done", "failed"), "failed": ("pending",), "neo4j_done": ()}


def may_follow(old, new) -> Column:
    out = col(old) == col(new)
    for a, others in STATES.items():
        out = out | ((col(old) == a) & col(new).isin(*others)) if others else out
    return F.coalesce(out, F.lit(False))


def fit_budget(rows: DataFrame, budget: int, by: str, order: str, size: str) -> DataFrame:
    """(by, kept, used): items in order, each taken if it still fits into the budget; one that does not is skipped and the rest tried on.

    A fold over the group's ordered array within one row: sizes and keys only travel, not texts. Null sizes count 0.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))))
    kind = rows.schema[order].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("kept"))
    step = lambda s, x: F.when(s["used"] + x["n"] <= budget, F.struct((s["used"] + x["n"]).alias("used"), F.concat(s["kept"], F.array(x["o"])).alias("kept"))).otherwise(s)
    return rows.groupBy(by).agg(items.alias("__i")).withColumn("__f", F.aggregate("__i", start, step)).select(by, F.col("__f.kept").alias("kept"), F.col("__f.used").alias("used"))


def summary_by(rows: DataFrame, column: str, value: str = "value") -> DataFrame:
    """(by, label, calls, total) grouped by a column chosen by name; an unknown name is an error before anything runs."""
    if column not in rows.columns:
        raise ValueError(f"no column {column} to group by")
    return rows.groupBy(F.col(column).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total")).select(F.lit(column).alias("by"), "label", "calls", "total")
