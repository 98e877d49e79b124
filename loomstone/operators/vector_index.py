"""Nearest vectors by inverted lists: coarse centroids, a list for each, probes of the nearest lists, exact ranking of what they hold.

Every vector is in the list of its nearest centroid (by cosine); null and zero vectors are in list -1. The lists are folders of a Parquet
table, so a search reads only those that it probes. Without a number of probes a search reads all lists and is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_dir
from ..workers import findable

SAMPLE, MOST_LISTS, FILE_BYTES = 20_000, 4096, 256 << 20


def _unit(rows) -> np.ndarray:
    v = np.array(rows, np.float64)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def fit_centroids(vectors: DataFrame, lists: int, vector: str = "embedding", sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """At most `lists` unit centroids by rounds of spherical k-means on the `sample` vectors of smallest hash, which is all that reaches the driver."""
    some = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<float>").alias("v")).orderBy(F.xxhash64("v")).limit(sample).toArrow()["v"]
    v = _unit(some.to_pylist() or np.zeros((0, 1)))
    v = v[np.abs(v).sum(1) > 0]
    if not len(v):
        return np.zeros((0, 1))
    c = v[np.random.default_rng(7).permutation(len(v))[:lists]]
    for _ in range(rounds):
        near = np.concatenate([(v[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(v), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, v)
        c = np.where(np.abs(total).sum(1, keepdims=True) > 0, _unit(total), c)
    return np.unique(c, axis=0)


class VectorIndex:
    """An index that is written at `path`: the lists, and the centroids beside them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("list").toArrow()  # at most MOST_LISTS
        self.centroids = np.array(rows["vector"].to_pylist(), np.float64) if len(rows) else np.zeros((0, 1))

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, lists: int | None = None, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> VectorIndex:
        """Writes the index of all rows of vectors. lists: by default the square root of their number, at most MOST_LISTS.

        keep: further columns that go with the vectors. A list's rows are dealt over files of about FILE_BYTES, so that a large one is
        read by many tasks.
        """
        spark, path = vectors.sparkSession, path or shared_dir(vectors.sparkSession)
        n = vectors.count()
        centroids = fit_centroids(vectors, max(1, min(MOST_LISTS, lists or round(n**0.5))), vector, sample)
        parts = max(1, -(-n * centroids.shape[1] * 4 // (max(1, len(centroids)) * FILE_BYTES)))
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, vector array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        source = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), *keep)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
        findable(spark)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    part = batch.slice(at, 4096)
                    of = np.full(len(part), -1, np.int32)
                    full = np.array([x is not None and len(x) == centroids.shape[1] for x in part.column(1).to_pylist()], bool)
                    if full.any() and len(centroids):
                        v = _unit(part.column(1).take(pa.array(np.nonzero(full)[0])).to_pylist())
                        of[full] = np.where(np.abs(v).sum(1) > 0, (v @ centroids.T).argmax(1), -1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of)], names=[*part.schema.names, "list"])

        dealt = source.mapInArrow(assign, f"{kinds}, list int").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
        made = dealt.repartition("list", "part").drop("part").write
        (made.partitionBy("list") if n else made).parquet(f"{path}/lists")
        return cls(spark, path)

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """The indexed rows with their list; with lists only theirs, which prunes folders at the scan."""
        every = self.spark.read.parquet(f"{self.path}/lists")
        return every if lists is None else every.where(F.col("list").isin(lists))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, threshold: float = -1.0, query_id: str = "query_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
        """(query_id, id, similarity, rank) of each query's k nearest vectors of at least the threshold in its `probes` nearest lists, by exact
        cosine; ties by id. probes None: in all lists, exact.

        Queries travel in blocks of `block` (their vectors and the numbers of their lists, a bounded broadcast), one scan of the block's lists for
        each. A task keeps k rows a query, so what is shuffled does not grow with the lists.
        """
        asked = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v"))
        blocks = max(1, -(-asked.count() // block))
        kinds = f"q {asked.schema['q'].dataType.simpleString()}, id {self.rows().schema['id'].dataType.simpleString()}, similarity double"
        every = None
        for at in range(blocks):
            some = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == at)).toArrow()  # about `block` rows
            if len(some):
                found = self._block(some["q"].to_pylist(), some["v"].to_pylist(), k, probes, threshold, kinds)
                every = found if every is None else every.unionByName(found)
        if every is None:
            every = self.spark.createDataFrame([], kinds)
        w = Window.partitionBy("q").orderBy(F.desc("similarity"), "id")
        return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("q", query_id)

    def probes_for(self, queries: DataFrame, k: int, target: float, query_id: str = "query_id", vector: str = "embedding", sample: int = 64) -> int:
        """The fewest lists to probe so that a `target` share of the k exact neighbours is found, measured on at most `sample` queries of smallest
        hash. Vectors without structure need many lists; this says how many."""
        some = queries.orderBy(F.xxhash64(query_id)).limit(sample)
        of = self.search(some, k, query_id=query_id, vector=vector).join(self.rows().select("id", "list"), "id").select(query_id, "list")
        rows, asked = of.collect(), {r[0]: r[1] for r in some.select(query_id, vector).collect()}  # at most sample * k rows
        place = {}
        for name, v in asked.items():
            order = np.argsort(-(_unit([v if v is not None else [0.0] * self.centroids.shape[1]])[0] @ self.centroids.T), kind="stable")
            place[name] = {int(j): p + 1 for p, j in enumerate(order)}
        need = sorted(place[r[0]].get(r["list"], len(self.centroids)) for r in rows)
        return max(1, need[min(len(need), int(np.ceil(target * len(need)))) - 1]) if need else 1

    def _block(self, names: list, vectors: list, k: int, probes: int | None, threshold: float, kinds: str) -> DataFrame:
        width = self.centroids.shape[1]
        q = _unit([x if x is not None and len(x) == width else [0.0] * width for x in vectors])
        lists, wanted = None, None
        if probes is not None:
            order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]
            wanted = {int(j): np.nonzero((order == j).any(1))[0] for j in np.unique(order)}
            lists = sorted(wanted)
        findable(self.spark)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, list]] = {}
            for batch in batches:
                of = batch.column(2).to_numpy(zero_copy_only=False)
                for j in np.unique(of).tolist():
                    rows = np.nonzero(of == j)[0]
                    who = np.arange(len(q)) if wanted is None else wanted.get(j, np.zeros(0, np.int64))
                    for a in range(0, len(rows), 2048):
                        part = batch.take(pa.array(rows[a : a + 2048]))
                        ids = part.column(0).to_pylist()
                        v = _unit([x if x is not None and len(x) == width else [0.0] * width for x in part.column(1).to_pylist()])
                        near = np.round(q[who] @ v.T, 12)  # equal vectors tie, wherever they lie in a product
                        for i, row in zip(who.tolist(), near):
                            good = np.nonzero(row >= threshold)[0]
                            if i in best and len(best[i][1]) == k:
                                good = good[row[good] >= best[i][0][-1]]
                            if len(good):
                                old, old_ids = best.get(i, (np.zeros(0), []))
                                both, both_ids = np.concatenate([old, row[good]]), [*old_ids, *(ids[g] for g in good.tolist())]
                                order = sorted(range(len(both)), key=lambda x: (-both[x], both_ids[x] is not None, both_ids[x]))[:k]  # noqa: B023
                                best[i] = (both[order], [both_ids[x] for x in order])
            flat = [(names[i], x, float(s)) for i, (sims, found) in best.items() for x, s in zip(found, sims)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(flat, columns=["q", "id", "similarity"]), schema=schema, preserve_index=False)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        schema = to_arrow_schema(_parse_datatype_string(kinds))
        return self.rows(lists).select("id", "v", "list").mapInArrow(nearest, kinds)


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One row (queries, recall): the share of the exact answer's rows that was found, averaged over the queries."""
    hits = exact.select(query_id, "id").join(found.select(query_id, "id", F.lit(1).alias("hit")), [query_id, "id"], "left")
    per = hits.groupBy(query_id).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.avg("r").alias("recall"))
