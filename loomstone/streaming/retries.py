"""Retries as a stream: failures wait in keyed state until a timer says that they are due; used-up ones go to the dead letters.

State is kept by part (a hash of host and item), so that a host with very many failures is not one task's, nor has each of very many hosts a group
of its own. What waits in a part is one value, read and written once a batch, and its timer is set for the first that is due (60 * 2^attempt
seconds after it failed, as surveyed): a call of the state costs far more than a row, so calls grow with the parts and not with the failures. When
the timer fires, all that is due comes out, and the next is set. Times are event times, so a run that is started again from its checkpoint gives
the same rows; a checkpoint from before parts held hosts cannot be continued. Timers count milliseconds: a failure's time goes to the nearest
one before the watermark and the due time are taken from it, so that both round alike; a dead row keeps its time whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..workers import findable

OUT = "kind string, host string, item string, attempt int, due timestamp, at timestamp"


def use_rocksdb(spark) -> None:
    """State with timers needs the RocksDB store; set it before the first such stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Retries(StatefulProcessor):
    """(item, host, attempt, failed_at in whole milliseconds, told, outcome) in; retry and dead rows out. told: the time as it came.

    outcome "failed": the item waits, or is dead if its attempts are used up. "done": a waiting item of that name leaves. An item that fails
    again while it waits takes the later failure's time. What has come out, or left, has no state any more.
    """

    def __init__(self, most: int = 3, base: int = 60):
        self.most, self.base = most, base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "host array<string>, item array<string>, attempt array<int>, due array<bigint>")

    def _held(self) -> dict[tuple[str, str], tuple[int, int]]:
        """(host, item) -> (attempt, due) of what waits in the part."""
        held = self.waiting.get()
        return {} if held is None else {(h, i): (a, d) for h, i, a, d in zip(*held)}

    def _keep(self, held: dict[tuple[str, str], tuple[int, int]]) -> None:
        if held:
            hosts, items = zip(*held)
            attempts, due = zip(*held.values())
            self.waiting.update((list(hosts), list(items), list(attempts), list(due)))
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values(["told", "host", "item", "attempt"], kind="stable")
        dead, old = [], self._held()
        held = dict(old)
        millis = whole["failed_at"].astype("datetime64[ms]").astype("int64")
        for host, item, attempt, at, told, outcome in zip(whole["host"], whole["item"], whole["attempt"], millis.tolist(), whole["told"], whole["outcome"]):
            if outcome == "done" or int(attempt) >= self.most:
                held.pop((host, item), None)
                if outcome != "done":
                    dead.append(("dead", host, item, int(attempt), pd.NaT, told))
            else:
                held[host, item] = int(attempt) + 1, at + self.base * 1000 * 2 ** int(attempt)
        if held != old:
            self._keep(held)
        # A timer is set for the first of the old ones, or before: where that one has left, it finds nothing due and sets the next.
        first = min((due for _, due in held.values()), default=None)
        if first is not None and first < min((due for _, due in old.values()), default=first + 1):
            self.handle.registerTimer(first)
        yield _frame(dead)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), self._held()
        at, left = pd.Timestamp(now, unit="ms"), {name: x for name, x in held.items() if x[1] > now}
        if len(left) < len(held):
            self._keep(left)
        if left:
            self.handle.registerTimer(min(due for _, due in left.values()))
        yield _frame([("retry", *name, attempt, pd.Timestamp(due, unit="ms"), at) for name, (attempt, due) in held.items() if due <= now])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "host", "item", "attempt", "due", "at"])
    for c in ("due", "at"):
        out[c] = pd.to_datetime(out[c])
    out["attempt"] = out["attempt"].astype("int32")
    return out


def retry_stream(failures: DataFrame, late: str = "0 seconds", most: int = 3, base: int = 60, parts: int = 4096) -> DataFrame:
    """A stream of (kind, host, item, attempt, due, at) from one of (item, host, attempt, failed_at, outcome). Rows without an item, host or
    time are left out. parts: how many values hold what waits; a batch rewrites those that it touches, so state it by how much waits at once."""
    findable(failures.sparkSession)
    use_rocksdb(failures.sparkSession)
    rows = failures.select(F.col("host").cast("string").alias("host"), F.col("item").cast("string").alias("item"), F.col("attempt").cast("int").alias("attempt"), F.col("failed_at").cast("timestamp").alias("failed_at"), F.coalesce("outcome", F.lit("failed")).alias("outcome"))
    nearest = F.timestamp_millis(F.round(F.unix_micros("failed_at") / 1000).cast("long"))
    rows = rows.where("host IS NOT NULL AND item IS NOT NULL AND failed_at IS NOT NULL").withColumn("told", F.col("failed_at")).withColumn("failed_at", nearest).withColumn("part", F.pmod(F.xxhash64("host", "item"), F.lit(parts))).withWatermark("failed_at", late)
    return rows.groupBy("part").transformWithStateInPandas(Retries(most, base), OUT, "Append", "EventTime")
