"""How plans register: a name, a function (spark, folder) -> DataFrame, and its SQL for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# What the two dialects write differently.
SPARK = {"@JSON_K": "CAST(get_json_object(props, '$.k') AS BIGINT)", "@LIST(": "array("}
DUCK = {"@JSON_K": "CAST(json_extract(props, '$.k') AS BIGINT)", "@LIST(": "list_value("}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _trunc(sql: str, spark: bool) -> str:
    put = r"CAST(date_trunc('\1', \2) AS TIMESTAMP_NTZ)" if spark else r"CAST(date_trunc('\1', \2) AS TIMESTAMP)"
    return re.sub(r"@TRUNC\((\w+), ([\w.]+)\)", put, sql)


def _spelled(sql: str, words: dict[str, str], spark: bool) -> str:
    for k, v in words.items():
        sql = sql.replace(k, v)
    return _trunc(sql, spark)


def spark_text(sql: str) -> str:
    return _spelled(sql, SPARK, True)


def duck_text(sql: str) -> str:
    return _spelled(sql, DUCK, False)


class Registry:
    def __init__(self):
        self.QUERIES: dict = {}
        self.SQL: dict[str, str] = {}

    def sql(self, name: str, text: str) -> None:
        """A declarative plan: Catalyst gets it as Spark SQL over the tables it names."""

        def run(spark: SparkSession, folder: str) -> DataFrame:
            named = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
            return spark.sql(re.sub(r"\b(FROM|JOIN|,)\s+(" + "|".join(named) + r")\b", lambda m: f"{m[1]} {{{m[2]}}}", spark_text(text)), **{t: table(spark, folder, t) for t in named})

        self.QUERIES[name] = run
        self.SQL[name] = duck_text(text)

    def frame(self, name: str, sql: str | None = None):
        def add(f):
            self.QUERIES[name] = f
            if sql:
                self.SQL[name] = duck_text(sql)
            return f

        return add
