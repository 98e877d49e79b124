"""Reading and writing tables: shared intermediate tables, keyed merges, schema evolution, migration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TASK_ROWS = 2_000_000  # narrow rows that a task sorts or holds


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under spark.checkpoint.dir. Where that is unset, a local session (a test) gets a temporary folder; on a cluster that
    is an error, since executors would each write to their own disk."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="loomstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and lost executors cost nothing that was done."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        path = getattr(df, "__dict__", {}).get("written_path")
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None, rows: int | None = None) -> DataFrame:
    """Rows of both, one for each key: the new one wins, among new ones the last by `order`. Missing columns become null.

    rows: how many rows both have, at most; they are then dealt by key over tasks of about TASK_ROWS, so that what a task sorts or holds does not
    grow with the tables. Rows of nothing but keys are the same old or new: each stays once, and nothing is sorted.
    """
    dealt = lambda df: df if rows is None else df.repartition(tasks_for(rows), *keys)
    if set(old.columns) == set(new.columns) == set(keys):
        return dealt(old.unionByName(new)).distinct()
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), *([F.desc_nulls_last(order)] if order else []), F.desc(F.xxhash64(*new.columns)))
    both = dealt(old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def ensure_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """df with missing columns added as nulls of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns})


def read_since(df: DataFrame, key: str, last) -> DataFrame:
    """Rows beyond the last key: a filter that reaches the Parquet scan."""
    return df if last is None else df.where(F.col(key) > F.lit(last))


def migrate(spark: SparkSession, source: dict[str, str], target: str, rules: dict[str, dict[str, str]] | None = None) -> dict[str, str]:
    """Copies tables (name -> Parquet path) below target, columns renamed by rules; status of each: done or its error."""
    status = {}
    for name, path in source.items():
        try:
            df = spark.read.parquet(path)
            for old, new in (rules or {}).get(name, {}).items():
                df = df.withColumnRenamed(old, new)
            df.write.mode("overwrite").parquet(f"{target}/{name}")
            status[name] = "done"
        except Exception as e:  # one table's failure leaves the others whole
            status[name] = f"failed: {e}"
    return status


def schema_of(df: DataFrame) -> DataFrame:
    """(name, kind) of a table's columns in order."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "name string, kind string")


def key_of(name: str, df: DataFrame) -> DataFrame:
    """One row (name, key, holds): the key is the column `id`, else the first one; whether it is unique."""
    key = "id" if "id" in df.columns else df.columns[0]
    return df.agg(F.lit(name).alias("name"), F.lit(key).alias("key"), (F.count(F.lit(1)) == F.countDistinct(key)).alias("holds"))


def property_keys(df: DataFrame, label: str, props: str) -> DataFrame:
    """(label, key): which properties, in a JSON text, the rows of each label have."""
    return df.select(F.col(label).alias("label"), F.explode(F.json_object_keys(props)).alias("key")).distinct()


def property_sample(df: DataFrame, label: str, key: str, props: str) -> DataFrame:
    """(label, sampled, kind): the schema of one row's properties of each label, that of the smallest key."""
    first = df.where(F.col(props).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.min_by(F.struct(F.col(key).alias("k"), F.col(props).alias("p")), key).alias("s"))
    return first.select("label", F.col("s.k").alias("sampled"), F.transform(F.json_object_keys("s.p"), lambda k: k).alias("kind"))


def verified(name: str, found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row (name, found, whole): rows of a sink, and whether they are as many as expected."""
    n = expected.agg(F.count(F.lit(1)).alias("__n"))
    return found.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("found")).join(F.broadcast(n)).select("name", "found", (F.col("found") >= F.col("__n")).alias("whole"))
