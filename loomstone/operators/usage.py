"""Roll-ups of usage records and of graphs: sums by label and time, pivots, failures, states, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(calls: DataFrame, by: list[str], **measures: Column) -> DataFrame:
    """One row for each value of by (none: one row): `calls`, and the given aggregates."""
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *[m.alias(n) for n, m in measures.items()])


def rollup_by_time(calls: DataFrame, at: str, unit: str, by: list[str] = (), **measures: Column) -> DataFrame:
    """summary() by the hour, day or month (`bucket`) and other columns."""
    return summary(calls.withColumn("bucket", F.date_trunc(unit, F.col(at)).cast("timestamp_ntz")), ["bucket", *by], **measures)


def pivot_counts(rows: DataFrame, by: str, kind: str, columns: dict[str, str]) -> DataFrame:
    """Counts of stated kinds as columns (value to name): the kinds are given, so that nothing is scanned to find them."""
    return rows.groupBy(by).agg(*[F.count(F.when(F.col(kind) == v, 1)).alias(n) for v, n in columns.items()])


def failure_stats(failures: DataFrame, a: str, b: str, at: str) -> DataFrame:
    """Counts and last time by both columns, each of them, and in all, from one scan."""
    return failures.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last_seen"))


def state_histogram(rows: DataFrame, state: str, states: list[str]) -> DataFrame:
    """(status, n) of every stated state, also of those without rows."""
    wanted = rows.sparkSession.createDataFrame([(s,) for s in states], "status string")
    n = rows.groupBy(F.col(state).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def share_of(rows: DataFrame, by: str, test: Column, name: str) -> DataFrame:
    return rows.groupBy(by).agg((F.count(F.when(test, 1)) / F.count(F.lit(1))).alias(name))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts (single rows joined)."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.join(F.broadcast(n))
    return out


def degrees_of(nodes: DataFrame, key: str, edges: DataFrame, end: str, **others: str) -> DataFrame:
    """Each node with counts of distinct other ends (name=column); nodes without edges have 0."""
    n = edges.groupBy(F.col(end).alias(key)).agg(*[F.countDistinct(c).alias(name) for name, c in others.items()])
    return nodes.select(key).join(n, key, "left").select(key, *[F.coalesce(name, F.lit(0)).alias(name) for name in others])


def top_by_count(rows: DataFrame, by: str, limit: int, name: str = "degree", least: int = 0) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) >= least).orderBy(F.desc(name), by).limit(limit)


def two_ends(edges: DataFrame, a: tuple[DataFrame, str, str], b: tuple[DataFrame, str, str]) -> DataFrame:
    """edges with `c1` and `c2`, the group of each end; an end is (membership, edge column, group column), joined by the edge column's name."""
    for name, (members, end, group) in (("c1", a), ("c2", b)):
        edges = edges.join(members.select(end, F.col(group).alias(name)), end)
    return edges


def errors_by_type(calls: DataFrame, kind: str, failed: Column) -> DataFrame:
    """(kind, n) of the calls that failed; an unknown kind is "unknown"."""
    return calls.where(failed).groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def page_count(rows: DataFrame, size: int = 20) -> DataFrame:
    """One row (total, pages) of a filtered listing."""
    return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def mean_degree(nodes: DataFrame, node: str, edges: DataFrame, end: str) -> DataFrame:
    """One row (mean): edges a node, nodes without any included; edges of no listed node do not count."""
    known = nodes.select(F.col(node).alias("n")).distinct()
    touching = edges.join(known, F.col(end) == F.col("n"), "left_semi").agg(F.count(F.lit(1)).alias("e"))
    one = nodes.agg(F.count(F.lit(1)).alias("all")).join(F.broadcast(touching))  # two single rows
    return one.select(F.when(F.col("all") > 0, F.col("e") / F.col("all")).alias("mean"))


def group_sizes(members: DataFrame, group: str) -> DataFrame:
    """One row (communities, mean_size, largest, smallest)."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("communities"), F.avg("size").alias("mean_size"), F.max("size").alias("largest"), F.min("size").alias("smallest"))


def counted_sure(events: DataFrame, by: str, enough: int = 10) -> DataFrame:
    """(by, events, sure): whether there are enough of them to be sure of the count."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("events")).withColumn("sure", F.least(F.lit(1.0), F.col("events") / float(enough)) >= 1.0)


def dropped_over(series: DataFrame, by: str, order: list[str], value: str, steps: int = 2, more_than: float = 0.05) -> DataFrame:
    """series with `dropped`: whether the value is lower than `steps` rows before by more than the amount; null before there are so many."""
    w = Window.partitionBy(by).orderBy(*order)
    return series.withColumn("dropped", F.lag(value, steps).over(w) - F.col(value) > more_than)
