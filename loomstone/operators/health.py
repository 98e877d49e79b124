"""Health of graphs and of their communities: issues, scores, repairs, and what changed since the last detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col


def graph_score(entities, orphans, largest, mean_degree) -> Column:
    """0 to 100: 30 for orphans, 20 for what is outside the largest component, 20 or 10 for few edges. 0 without entities."""
    n = col(entities)
    score = 100 - 30 * col(orphans) / n - 20 * (1 - col(largest) / n) - F.when(col(mean_degree) < 1, 20.0).when(col(mean_degree) < 2, 10.0).otherwise(0.0)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(0.0)


def advice(entities, orphans, components, mean_degree) -> Column:
    """Names of what to mend."""
    tests = (("orphans", (col(entities) > 0) & (col(orphans) / col(entities) > 0.1)), ("sparse", col(mean_degree) < 1.5), ("components", col(components) > 10))
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))


def build_communities(members: DataFrame, level: int = 0, parents: DataFrame | None = None) -> DataFrame:
    """(community, level, parent, entity_count, rank): rank is a tenth of the size, at most 10. members (node, community); parents (community, parent)."""
    made = members.groupBy("community").agg(F.countDistinct("node").alias("entity_count"))
    made = made.select("community", F.lit(level).alias("level"), "entity_count", F.least(F.col("entity_count") / 10.0, F.lit(10.0)).alias("rank"))
    return made.join(parents, "community", "left") if parents is not None else made.withColumn("parent", F.lit(None).cast(members.schema["community"].dataType))


def issues(communities: DataFrame, members: DataFrame, reports: DataFrame, now: Column, modularity: float | None = None, age_days: int = 7) -> DataFrame:
    """(community, issue): empty, count_mismatch, missing_report, stale_report, hierarchy_break; low_modularity has no community.

    communities (community, parent, entity_count); members (node, community); reports (community, stale, updated_at). Counts come from one
    aggregate that all checks share.
    """
    actual = members.groupBy("community").agg(F.countDistinct("node").alias("actual"))
    said = reports.groupBy("community").agg(F.max(F.coalesce("stale", F.lit(False)) | (F.col("updated_at") < now - F.expr(f"INTERVAL {age_days} DAYS"))).alias("stale"), F.lit(True).alias("reported"))
    up = communities.select(F.col("community").alias("parent"), F.lit(True).alias("has_parent")).distinct()
    every = communities.join(actual, "community", "left").join(said, "community", "left").join(up, "parent", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    tests = (
        ("empty", F.col("actual") == 0), ("count_mismatch", (F.col("actual") > 0) & ~F.col("entity_count").eqNullSafe(F.col("actual"))), ("missing_report", F.col("reported").isNull()),
        ("stale_report", F.col("stale")), ("hierarchy_break", F.col("parent").isNotNull() & F.col("has_parent").isNull()),
    )
    found = every.select("community", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))).alias("issue"))
    if modularity is not None and modularity < 0.1:
        kind = communities.schema["community"].dataType
        found = found.unionByName(communities.groupBy().agg(F.lit(None).cast(kind).alias("community"), F.lit("low_modularity").alias("issue")))
    return found


def community_score(communities: DataFrame, found: DataFrame, modularity: float | None = None) -> DataFrame:
    """One row (score, status): 100 less the penalties of all issues; 0 without communities."""
    kinds = ("empty", "count_mismatch", "missing_report", "stale_report", "hierarchy_break")
    n = found.agg(*[F.coalesce(F.sum((F.col("issue") == k).cast("int")), F.lit(0)).alias(k) for k in kinds])
    total = communities.agg(F.count(F.lit(1)).alias("total"))
    share = lambda k: F.col(k) / F.col("total")
    low = 0.0 if modularity is None or modularity >= 0.1 else 20.0 if modularity < 0 else 10.0
    lost = [
        F.when(share("empty") >= 0.10, 30.0).when(share("empty") >= 0.05, 15.0), F.when(share("count_mismatch") > 0.20, 10.0), F.when(share("missing_report") > 0.30, 10.0),
        F.when(F.col("stale_report") > 0, 5.0), F.when(F.col("hierarchy_break") > 0, 15.0),
    ]
    score = F.when(F.col("total") > 0, F.greatest(F.lit(0.0), 100.0 - low - reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in lost]))).otherwise(0.0)
    return total.join(F.broadcast(n)).select(score.alias("score")).withColumn("status", F.when(F.col("score") >= 80, "healthy").when(F.col("score") >= 60, "moderate").when(F.col("score") >= 40, "degraded").otherwise("critical"))  # two single rows


def repair(communities: DataFrame, members: DataFrame) -> DataFrame:
    """communities without the empty ones, with true counts, and without parents that do not exist."""
    actual = members.groupBy("community").agg(F.countDistinct("node").alias("__n"))
    alive = communities.join(actual, "community").withColumn("entity_count", F.col("__n")).drop("__n")
    up = alive.select(F.col("community").alias("parent"), F.lit(True).alias("__up")).distinct()
    return alive.join(up, "parent", "left").withColumn("parent", F.when(F.col("__up"), F.col("parent"))).select(*communities.columns)


def drifted(communities: DataFrame, members: DataFrame, share: float = 0.2) -> DataFrame:
    """(community, stored, actual) whose stored count is off by more than share of the stored one; a stored 0 drifts with any member."""
    actual = members.groupBy("community").agg(F.countDistinct("node").alias("actual"))
    both = communities.select("community", F.coalesce("entity_count", F.lit(0)).alias("stored")).join(actual, "community", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.where(F.abs(F.col("stored") - F.col("actual")) > share * F.col("stored"))


def assignment_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, before, after, change) between two memberships (node, community): assigned, removed or moved. Unchanged nodes are left out."""
    both = old.select("node", F.col("community").alias("before")).join(new.select("node", F.col("community").alias("after")), "node", "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", F.when(F.col("before").isNull(), "assigned").when(F.col("after").isNull(), "removed").otherwise("moved"))


def update_due(pending, minutes, changed_share, days) -> Column:
    """Whether communities are to be detected anew: 50 waiting, or some for 30 minutes, a tenth changed, or a week passed."""
    return (col(pending) >= 50) | ((col(pending) > 0) & (col(minutes) >= 30)) | (col(changed_share) > 0.1) | (col(days) >= 7)
