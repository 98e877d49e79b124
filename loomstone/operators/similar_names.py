"""Candidates for resolution by name: a set-similarity join of character q-grams, without comparing all names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.tables import written


def grams(name, q: int = 3) -> Column:
    """Distinct q-grams of the lower-cased name with q - 1 marks around it; none for null and empty names."""
    text = F.lower(F.coalesce(col(name), F.lit("")))
    padded = F.concat(F.lit("\x02" * (q - 1)), text, F.lit("\x03" * (q - 1)))
    all_ = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda k: F.substring(padded, k, F.lit(q))))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(all_)


def name_links(names: DataFrame, share: int = 60, name: str = "name", q: int = 3) -> DataFrame:
    """(a, b, similarity), a < b: distinct names whose gram sets have 100 * intersection >= share * union.

    Grams are ordered by rarity over all names. A pair that links has a gram in common among the first n - ceil(2 * share * n / (100 + share)) + 1 of
    the smaller set and the first n - ceil(share * n / 100) + 1 of the other; only these are joined, by gram, with sizes and places that still allow
    the overlap, and then whole sets are compared. Rows grow with names that share a rare gram, not with all pairs; a gram that most names share is the
    last of each and joins nothing but names that consist of such grams. Null and empty names have no links.
    """
    sets = written(names.select(F.col(name).alias("x")).where(F.coalesce(F.col(name), F.lit("")) != "").distinct().select("x", grams("x", q).alias("g")))
    each = sets.select("x", F.explode("g").alias("t"))
    df = each.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(df, "t").groupBy("x").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))  # a name's grams: as many as its letters
    n = F.size("o")
    ceil = lambda num, den: F.expr(f"cast(({num} + {den} - 1) div {den} as int)")
    sized = ordered.withColumn("n", n).withColumn("long", F.col("n") - ceil(f"{share} * n", 100) + 1).withColumn("short", F.col("n") - ceil(f"{2 * share} * n", 100 + share) + 1)
    prefix = written(sized.select("x", "n", "short", F.posexplode(F.slice("o", F.lit(1), F.col("long"))).alias("pos", "o")).select("x", "n", "pos", (F.col("pos") < F.col("short")).alias("short"), F.col("o.t").alias("t")))
    left = prefix.where("short").select("t", F.col("x").alias("a"), F.col("n").alias("an"), F.col("pos").alias("ap"))
    right = prefix.select("t", F.col("x").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"))
    smaller = (F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b")))
    fits = F.lit(100) * F.col("an") >= F.lit(share) * F.col("bn")
    enough = F.lit(100 + share) * F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) >= F.lit(share) * (F.col("an") + F.col("bn"))
    pairs = left.join(right, "t").where(smaller & fits & enough).select("a", "b").distinct()
    both = pairs.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - common
    return both.where(F.lit(100) * common >= F.lit(share) * union).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (common / union).alias("similarity"))


def name_candidates(entities: DataFrame, asked: DataFrame, share: int = 60, name: str = "name", q: int = 3) -> DataFrame:
    """(asked, name, similarity) of the entities whose names are alike an asked name; equal ones are, with similarity 1."""
    both = entities.select(F.col(name).alias("n")).distinct(), asked.select(F.col(name).alias("n")).distinct()
    links = name_links(both[0].unionByName(both[1]).distinct(), share, "n", q)
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    same = both[1].where(F.coalesce("n", F.lit("")) != "").select(F.col("n").alias("a"), F.col("n").alias("b"), F.lit(1.0).alias("similarity"))
    found = ways.unionByName(same).join(both[1].withColumnRenamed("n", "a"), "a", "left_semi").join(both[0].withColumnRenamed("n", "b"), "b", "left_semi")
    return found.select(F.col("a").alias("asked"), F.col("b").alias("name"), "similarity")
