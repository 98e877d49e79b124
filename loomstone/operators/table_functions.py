"""Python table functions for SQL: they read a table argument, partitioned and ordered by the caller, and keep a few numbers of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class FitBudget:
    """fit_budget(TABLE(rows) PARTITION BY ... ORDER BY ..., budget): rows (name, item, size) in order, each taken if it still fits into the
    partition's budget; one that does not is skipped and the rest tried on. Null sizes count 0. State is one sum a partition."""

    def __init__(self):
        self.used = 0

    def eval(self, row, budget: int):
        size = row["size"] or 0
        if self.used + size <= budget:
            self.used += size
            yield row["name"], row["item"], size, self.used


RETURNS = "name string, item string, size bigint, used bigint"


def register(spark: SparkSession) -> None:
    """Makes the functions callable in the session's SQL."""
    spark.udtf.register("fit_budget", udtf(FitBudget, returnType=RETURNS))


def fit_budget(rows: DataFrame, budget: int, by: str, order: str, item: str, size: str) -> DataFrame:
    """(name, item, size, used) of what fits, by the table function: groups are dealt by `by`, and each is read in order, a row at a time."""
    table = rows.select(F.col(by).cast("string").alias("name"), F.col(item).cast("string").alias("item"), F.col(size).cast("bigint").alias("size"), F.col(order).alias("place"))
    return udtf(FitBudget, returnType=RETURNS)(table.asTable().partitionBy("name").orderBy("place", "item"), F.lit(budget))
