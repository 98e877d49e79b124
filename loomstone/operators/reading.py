"""Rows of a table by state, time, text, membership and order: the reads of a service, as functions of tables and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """`limit` rows from `offset` on in an order (the caller makes it total by a key at its end): a top-k per task, then one of few rows."""
    out = rows.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def where_all(rows: DataFrame, equal: dict | None = None, below: dict | None = None, least: dict | None = None) -> DataFrame:
    """Rows that meet every given bound: column = value, column < value, column >= value. The filters reach the scan."""
    for test, bounds in ((lambda c, v: c == v, equal), (lambda c, v: c < v, below), (lambda c, v: c >= v, least)):
        for name, value in (bounds or {}).items():
            rows = rows.where(test(F.col(name), F.lit(value)))
    return rows


def in_state(rows: DataFrame, state: str, value: str, order: list | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a state, the oldest first if an order and a limit are given."""
    out = rows.where(F.col(state) == value)
    return out if limit is None else page(out, order or [], limit)


def relative_to_last(rows: DataFrame, at: str) -> DataFrame:
    """rows with `__last`, the greatest time of all: one aggregate, one row broadcast."""
    return rows.join(F.broadcast(rows.agg(F.max(at).alias("__last"))))


def older_than(rows: DataFrame, at: str, age: str) -> DataFrame:
    """Rows older than `age` (an interval) before the last one."""
    return relative_to_last(rows, at).where(F.col(at) < F.col("__last") - F.expr(f"INTERVAL {age}")).drop("__last")


def within_last(rows: DataFrame, at: str, age: str) -> DataFrame:
    return relative_to_last(rows, at).where(F.col(at) >= F.col("__last") - F.expr(f"INTERVAL {age}")).drop("__last")


def from_first(rows: DataFrame, at: str, span: str) -> DataFrame:
    """Rows of the first `span` of all times."""
    first = rows.agg(F.min(at).alias("__first"))
    return rows.join(F.broadcast(first)).where(F.col(at) <= F.col("__first") + F.expr(f"INTERVAL {span}")).drop("__first")


def existing(rows: DataFrame, known: DataFrame, column: str, known_column: str) -> DataFrame:
    return rows.join(known.select(F.col(known_column).alias("__k")).distinct(), F.col(column) == F.col("__k"), "left_semi")


def missing(rows: DataFrame, known: DataFrame, column: str, known_column: str) -> DataFrame:
    return rows.join(known.select(F.col(known_column).alias("__k")).distinct(), F.col(column) == F.col("__k"), "left_anti")


def text_search(rows: DataFrame, words: dict[str, str]) -> DataFrame:
    """Rows in which one of the columns contains its word, in any case."""
    found = F.lit(False)
    for name, word in words.items():
        found = found | F.lower(F.col(name)).contains(word.lower())
    return rows.where(found)


def not_pruned(rows: DataFrame, flag, strict: bool = False) -> DataFrame:
    """Rows that are not marked; an unknown mark counts as unmarked, but in strict reading the row goes."""
    marked = col(flag) == 1
    return rows.where(~marked if strict else ~F.coalesce(marked, F.lit(False)))


def keep_latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row for each value of by: the greatest by the order columns, in partial aggregates; no group is sorted."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*by).agg(F.max_by(whole, F.struct(*order)).alias("__r")).select("__r.*")


def label_rows(parts: dict[str, DataFrame], name: str = "kind") -> DataFrame:
    """All rows of the parts, each with the part's name."""
    out = None
    for label, df in parts.items():
        df = df.select(F.lit(label).alias(name), *df.columns)
        out = df if out is None else out.unionByName(df)
    return out


def surroundings(rows: DataFrame, by: list[str], order: list[str], key: str, reach: int = 2) -> DataFrame:
    """(key, before_k .. , after_k ..): the keys up to `reach` places before and after each row of a group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.select(F.col(key), *[F.lag(key, k).over(w).alias(f"before{k}") for k in range(reach, 0, -1)], *[F.lead(key, k).over(w).alias(f"after{k}") for k in range(1, reach + 1)])


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def index_scan(docs: DataFrame, text: str, source: str, sources: list[str]) -> DataFrame:
    """Documents with a text, of the sources: what an index is built from."""
    return docs.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(source).isin(sources))


def by_sections(rows: DataFrame, section: str, first: list[str], then: list[str]) -> DataFrame:
    """rows in the order of their sections (those of `first`, then all others), within one by the columns `then`."""
    place = F.lit(len(first))
    for k, name in reversed(list(enumerate(first))):
        place = F.when(F.col(section) == name, k).otherwise(place)
    return rows.orderBy(place, *then)
