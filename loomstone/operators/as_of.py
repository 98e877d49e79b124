"""Rows matched by time and by text: the last one before, the latest of a group, groups of equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(rows: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """(key, previous): the row of the same `by` with the greatest time strictly before, the greater key among equal times; null if none.

    A range frame ends one microsecond before the row, so rows of one time do not precede each other.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(by).orderBy("__us").rangeBetween(Window.unboundedPreceding, -1)
    return rows.select(by, key, micros.alias("__us")).select(F.col(key), F.max(F.struct("__us", key)).over(w)[key].alias("previous"))


def merge_into_latest(rows: DataFrame, group: str, key: str, at: str, has_body: Column) -> DataFrame:
    """(key, merged_into): each row of a group with the key of the group's latest row that has a body; groups without one are left out.

    The latest is found by partial aggregates; only (group, key) pairs are joined back.
    """
    target = rows.where(has_body).groupBy(group).agg(F.max_by(F.col(key), F.struct(at, key)).alias("merged_into"))
    return rows.select(group, key).join(target, group).select(key, "merged_into")


def text_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, n, rows, first, last) of equal texts: SHA-256, length, rows, smallest and greatest key. Texts themselves do not move; null
    texts are a group of their own with a null digest."""
    return rows.select(F.col(key).alias("k"), F.sha2(F.col(text).cast("binary"), 256).alias("digest"), F.length(text).cast("long").alias("n")).groupBy("digest", "n").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("first"), F.max("k").alias("last")).select("digest", "n", "rows", "first", "last")
