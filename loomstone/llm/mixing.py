"""Mixing sources to target weights: Efraimidis-Spirakis keys, sorted within source, prefix-summed to token budgets.

Each source is taken in complete epochs as far as its target goes; what remains is a weighted sample without replacement: the
documents with the smallest exponential keys -ln(u) / quality, up to the budget, the last one cut at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 4_096  # rows of one source that are sorted together


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))  # not by F.expr: a SQL literal unescapes the pattern


def text_quality(text: str) -> Column:
    """Weight in [0.05, 1]: the share of characters that are letters, digits, white space or plain punctuation, lower for capitals."""
    n = F.greatest(F.length(text), F.lit(1))
    odd = F.length(text) - F.length(F.translate(F.col(text), "#$%&*+/<=>@[]^_`{|}~\\", ""))
    capitals = F.length(text) - F.length(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return F.greatest(F.lit(0.05), F.coalesce(1 - 2 * odd / n - F.greatest(capitals / n - 0.2, F.lit(0.0)), F.lit(0.05)))


def exponential_key(weight: Column, *identity: str, seed: int = 17) -> Column:
    """-ln(u) / weight, u in (0, 1) from a hash of the identity columns: reruns agree on any partitioning."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def source_ranks(sources: DataFrame, source: str) -> DataFrame:
    """sources plus place (0, 1, ...): by code point, null last. Ranges are sorted apart; only their counts meet on the driver."""
    ordered = written(sources.repartitionByRange(F.col(source).asc_nulls_last()).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["count"]) for r in ordered.groupBy("__part").count().collect())
    before, at = [], 0
    for part, n in counts:
        before += [F.lit(part), F.lit(at)]
        at += n
    if not before:
        return ordered.withColumn("place", F.lit(0).cast("long")).drop("__part")
    w = Window.partitionBy("__part").orderBy(F.col(source).asc_nulls_last())
    return ordered.withColumn("place", (F.row_number().over(w) - 1 + F.create_map(*before)[F.col("__part")]).cast("long")).drop("__part")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, source: str = "source", size: str = "source_size") -> DataFrame:
    """One row per source: source, its size, target. Targets share the total size by weight (by place, repeating), none above
    cap * size; what a capped source cannot take goes to the others by weight until none is above."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = written(source_ranks(sources, source).withColumn("w", weight).withColumn("cap", F.col(size) * F.lit(float(cap))))
    total = ranked.agg(F.sum(size)).first()[0] or 0
    share = 0.0
    while True:  # the share only grows, and with it the set of capped sources
        full = F.col("cap") <= F.col("w") * F.lit(share)
        r = ranked.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("c"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        new = (total - (r["c"] or 0.0)) / r["w"] if r["w"] else share
        if new <= share * (1 + 1e-12):
            break
        share = new
    return ranked.select(source, size, F.least("cap", F.col("w") * F.lit(share)).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, source, keep, size (words), source_size, target, taken (words the mix takes, repeats counted).

    A source takes round(target) words exactly. Null text: size 0, taken 0. Null sources form one source. Equal rows tie: either
    may be the one that is cut. The texts are read once; what is shuffled has no text. Each source is cut into buckets of about
    BUCKET_ROWS keys; bucket totals are prefix-summed first, so no task sorts a whole source (one task sums a source's buckets: a million
    of them are 4 * 10^9 rows).
    """
    key = exponential_key(text_quality(text_col) if quality is None else quality, id_col, text_col)
    rows = written(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), *[F.col(c).alias(f"__keep_{c}") for c in keep], word_count(text_col).alias("size"), key.alias("key")))
    rows = rows.withColumn("part", F.coalesce(F.concat(F.lit("="), "__source"), F.lit("")))  # never null
    per_source = rows.groupBy("part").agg(F.first("__source").alias("__source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = written(per_source)
    targets = source_targets(sizes.select("__source", "source_size"), weights, cap, "__source")
    plan = sizes.drop("__source").join(targets.select(F.coalesce(F.concat(F.lit("="), "__source"), F.lit("")).alias("part"), "target"), "part")
    words = F.round("target").cast("long")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", words - F.col("epochs") * F.col("source_size"))
    plan = written(plan.withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS)))
    joined = rows.join(plan, "part").withColumn("bucket", F.floor(F.col("buckets") * F.col("key") / (1 + F.col("key"))))
    totals = joined.groupBy("part", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("part", "bucket").orderBy("key", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.join(starts, ["part", "bucket"]).withColumn("begins", F.col("start") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("begins")))
    return placed.select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), *[F.col(f"__keep_{c}").alias(c) for c in keep], "size", "source_size", "target", taken.cast("long").alias("taken"))
