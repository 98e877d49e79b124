"""A keyed table of Parquet files that commits: upserts, inserts, deletes and replacements are whole or not there at all.

Rows are dealt over buckets by a hash of their key. A change writes new files for the buckets that it touches, beside the old ones, and then
publishes a version: a small JSON file that names the folder of every bucket. Readers see the last published version; until then, and if
the writer dies before, the old one stands. A batch's id goes into its version, so a batch that is tried again changes nothing.

One writer at a time is meant; a second one that publishes the same version number is refused and can try again. Versions older than
those a reader may still hold are deleted by vacuum().
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import upsert

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer published this version first."""


class Files:
    """The few calls to the file system that holds a path, through Spark's own client."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        source = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def publish(self, name: str, text: str) -> bool:
        """The file appears whole under its name, or not at all; False if the name is taken."""
        part = self.path(f"_parts/{uuid.uuid4().hex}")
        out = self.fs.create(part, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.fs.mkdirs(self.path(name).getParent())
        done = not self.exists(name) and self.fs.rename(part, self.path(name))
        if not done:
            self.fs.delete(part, False)
        return done

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _digest(batch: str) -> str:
    return hashlib.sha256(batch.encode()).hexdigest()


class Versions:
    """Numbered versions of a table as small JSON files, and a ledger of the batches in it."""

    path: str
    files: Files

    @staticmethod
    def _name(number: int) -> str:
        return f"_versions/{number:012d}.json"

    def version(self, number: int | None = None) -> dict | None:
        """The last published version, or one by number."""
        if number is not None:
            return json.loads(self.files.read(self._name(number)))
        names = [n for n in self.files.names("_versions") if n.endswith(".json")]
        return json.loads(self.files.read(f"_versions/{names[-1]}")) if names else None

    def done(self, batch: str) -> bool:
        """Whether a batch is in the table: noted in the ledger, or named by the last version, whose note may not have been made."""
        return self.files.exists(f"_batches/{_digest(batch)}") or (self.version() or {}).get("batch") == batch

    def _note(self, version: dict) -> None:
        if version["batch"] is not None and not self.files.exists(f"_batches/{_digest(version['batch'])}"):
            self.files.publish(f"_batches/{_digest(version['batch'])}", str(version["number"]))

    def _publish(self, version: dict) -> None:
        if not self.files.publish(self._name(version["number"]), json.dumps(version)):
            raise Conflict(f"version {version['number']} of {self.path} is there already")
        self._note(version)


class KeyedTable(Versions):
    """keys: the columns that name a row; schema: DDL or a type, used when the table is new. buckets: how many; at 256 MB or so each.

    Null keys are keys like any other: rows that share them are one row.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str | T.StructType | None = None, buckets: int = 16):
        self.spark, self.path, self.keys, self.files = spark, path.rstrip("/"), list(keys), Files(spark, path)
        now = self.version()
        if now is None:
            if schema is None:
                raise ValueError(f"no table at {path}: give its schema")
            kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
            now = {"number": 0, "buckets": buckets, "keys": self.keys, "schema": kind.json(), "folders": {}, "batch": None}
            if set(self.keys) - set(kind.names):
                raise ValueError(f"the schema has no {sorted(set(self.keys) - set(kind.names))}")
            if not self.files.publish(self._name(0), json.dumps(now)):
                now = self.version()
        if now["keys"] != self.keys:
            raise ValueError(f"the table's keys are {now['keys']}")

    def _rows(self, version: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(version["schema"]))
        folders = [f for b, f in version["folders"].items() if buckets is None or int(b) in set(buckets)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of the last version (or one by number)."""
        return self._rows(self.version(number))

    def _bucket(self, version: dict, frame: DataFrame):
        kinds = {f["name"]: f for f in json.loads(version["schema"])["fields"]}
        of = [F.col(f"`{k}`").cast(T.StructField.fromJson(kinds[k]).dataType) for k in self.keys]
        return F.pmod(F.xxhash64(*of), F.lit(version["buckets"])).cast("int")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows whose keys `wanted` has; only their buckets' files are read."""
        now = self.version()
        touched = [r[0] for r in wanted.select(self._bucket(now, wanted)).distinct().collect()]  # at most the number of buckets
        return self._rows(now, touched).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def commit(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: str | None = None, whole: bool = False) -> bool:
        """Merges rows into the buckets that they touch (whole: into all) and publishes. merge(old, new) gives a bucket's rows of the table's columns.

        False, and nothing is done, if the batch is there already.
        """
        now = self.version()
        if batch is not None and self.done(batch):
            return False
        self._note(now)
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        new = rows.withColumn(BUCKET, self._bucket(now, rows))
        touched = list(range(now["buckets"])) if whole else sorted(r[0] for r in new.select(BUCKET).distinct().collect())
        old = self._rows(now, touched)
        merged = merge(old, new.drop(BUCKET)).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
        folder = f"data/{uuid.uuid4().hex}"
        merged.withColumn(BUCKET, self._bucket(now, merged)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        made = {n.split("=")[1]: f"{folder}/{n}" for n in self.files.names(folder) if n.startswith(f"{BUCKET}=")}
        strange = set(made) - set(map(str, touched))
        if strange:
            raise ValueError("merge gave rows of buckets that the change does not touch")
        kept = {b: f for b, f in now["folders"].items() if int(b) not in set(touched)}
        self._publish(now | {"number": now["number"] + 1, "folders": kept | made, "batch": batch})
        return True

    def upsert(self, rows: DataFrame, batch: str | None = None, order: str | None = None, keep_old=None) -> bool:
        """One row for each key: the new one, among new ones the last by `order`. keep_old: a condition on an old row that no new one replaces."""

        def merge(old, new):
            if keep_old is None:
                return upsert(old, new, self.keys, order)
            firm = old.where(keep_old).select(*[F.col(k).alias(f"__{k}") for k in self.keys])
            same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__{k}")) for k in self.keys]
            return upsert(old, new.join(firm, same, "left_anti"), self.keys, order)

        return self.commit(rows, merge, batch)

    def insert(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Rows whose keys are not there yet, one for each key (that of the smallest hash)."""
        return self.commit(rows, lambda old, new: upsert(new, old, self.keys), batch)

    def fill(self, rows: DataFrame, columns: Sequence[str], batch: str | None = None) -> bool:
        """Sets `columns` where the stored value is null; rows without a stored one do nothing."""

        def merge(old, new):
            given = new.groupBy(*self.keys).agg(*[F.max(F.col(c)).alias(f"__{c}") for c in columns]).withColumnsRenamed({k: f"__{k}" for k in self.keys})
            both = old.join(given, [F.col(f"`{k}`").eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left")
            return both.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in old.columns])

        return self.commit(rows, merge, batch)

    def delete(self, wanted: DataFrame, batch: str | None = None) -> bool:
        """Takes the rows of these keys away."""

        def merge(old, new):
            gone = new.select(*[F.col(k).alias(f"__{k}") for k in self.keys]).distinct()
            return old.join(gone, [F.col(f"`{k}`").eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_anti")

        return self.commit(wanted, merge, batch)

    def replace(self, rows: DataFrame, batch: str | None = None) -> bool:
        """All rows go, and these take their place, in one version."""
        return self.commit(rows, lambda old, new: upsert(old.limit(0), new, self.keys), batch, whole=True)

    def add_columns(self, wanted: dict[str, str]) -> None:
        """Adds missing columns; stored rows have null there. No file is rewritten."""
        now = self.version()
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        for name, kind in wanted.items():
            if name not in schema.names:
                schema = schema.add(name, T.DataType.fromDDL(kind))
        if schema.json() != now["schema"]:
            self._publish(now | {"number": now["number"] + 1, "schema": schema.json(), "batch": None})

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions but the last `keep`, and files that none of these names; the number of folders deleted. The ledger stays."""
        names = [n for n in self.files.names("_versions") if n.endswith(".json")]
        for n in names[:-keep]:
            self._note(json.loads(self.files.read(f"_versions/{n}")))
            self.files.delete(f"_versions/{n}")
        held = {f for n in names[-keep:] for f in json.loads(self.files.read(f"_versions/{n}"))["folders"].values()}
        gone = 0
        for folder in self.files.names("data"):
            for part in self.files.names(f"data/{folder}"):
                if part.startswith(f"{BUCKET}=") and f"data/{folder}/{part}" not in held:
                    self.files.delete(f"data/{folder}/{part}")
                    gone += 1
            if not any(f.startswith(f"data/{folder}/") for f in held):
                self.files.delete(f"data/{folder}")
        self.files.delete("_parts")
        return gone


def stream_into(stream: DataFrame, table: KeyedTable, name: str, checkpoint: str, order: str | None = None, write: Callable[[DataFrame, str], bool] | None = None):
    """A stream writer whose batches are upserts: each is in the table once, however often the stream is started again."""

    def put(batch: DataFrame, number: int) -> None:
        label = f"{name}/{number}"
        (write or (lambda rows, b: table.upsert(rows, b, order)))(batch, label)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
