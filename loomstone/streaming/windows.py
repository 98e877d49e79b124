"""Structured Streaming: hourly roll-up with a watermark, deduplication with state, and files as the stream's source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


def event_stream(spark: SparkSession, path: str, files_a_batch: int = 16) -> DataFrame:
    """A Parquet file or folder as a stream; times become TIMESTAMP, which watermarks need. The source wants a folder or a pattern."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "2 hours", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Calls, least and largest value by hour and keys; state of hours older than the watermark goes."""
    w = F.window("ts", "1 hour")
    return events.withWatermark("ts", late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("calls"), F.min("value").alias("least"), F.max("value").alias("most"))


def sliding(events: DataFrame, size: str = "10 minutes", slide: str = "5 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("calls"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("calls"))


def first_of_key(events: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """One row for each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Everything that is there, then stop; the result is a table in the shared folder (complete mode: the last batch's). A batch writes a
    folder of its own, so one that is tried again replaces what it wrote."""
    spark = stream.sparkSession
    out, state = shared_dir(spark), shared_dir(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'last' if mode == 'complete' else f'part-{number}'}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def near_seen(rows: DataFrame, fp: str = "fp", bits: int = 3, keep: str = "7 days", at: str = "ts") -> DataFrame:
    """A stream of (id, near): whether a row's fingerprint is within `bits` (at most 3) of one that came before, in the last `keep`.

    Each row goes to the state of its four 16-bit parts; what is within 3 bits shares one of them. A part's state holds the distinct
    fingerprints seen and when; older ones leave it when it is next used, and an unused part's state times out.
    """
    from ..operators.intake import bands

    spread = rows.withWatermark(at, keep).select("id", at, fp, F.explode(bands(fp)).alias("band"))
    spread = spread.select("id", F.col(at).alias("at"), F.col(fp).alias("fp"), F.col("band.number").alias("number"), F.col("band.value").alias("value"))
    long = {"days": 86_400_000, "hours": 3_600_000, "minutes": 60_000}
    size, unit = keep.split()
    ttl = int(size) * long[unit if unit.endswith("s") else unit + "s"]

    def look(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        seen, times = (list(map(list, state.get)) if state.exists else ([], []))
        known = dict(zip(seen, times))
        whole = pd.concat(list(batches)).sort_values(["at", "id"])
        ids, near = [], []
        for i, t, f in zip(whole["id"], whole["at"].astype("int64") // 1_000_000, whole["fp"]):
            ids.append(i)
            near.append(any(((f ^ g) & (2**64 - 1)).bit_count() <= bits and t - s <= ttl for g, s in known.items()))
            known[f] = t
        last = max(known.values())
        known = {g: s for g, s in known.items() if last - s <= ttl}
        state.update((list(known), list(known.values())))
        state.setTimeoutTimestamp(max(last + ttl, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": ids, "number": key[0], "near": near})

    return spread.groupBy("number", "value").applyInPandasWithState(look, "id long, number int, near boolean", "seen array<long>, times array<long>", "append", "EventTimeTimeout")
