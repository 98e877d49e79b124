"""The retry stream against a plain simulation, over several batches and a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomstone.sources import keyed
from loomstone.streaming import retries

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "item string, host string, attempt int, failed_at timestamp, outcome string"


def batches(seed, n=5):
    """Each batch's times lie after the batch before."""
    r, out = random.Random(seed), []
    for b in range(n):
        rows = []
        for _ in range(12):
            rows.append((f"i{r.randint(0, 9)}", f"h{r.randint(0, 2)}", r.randint(0, 4), START + dt.timedelta(seconds=b * 200 + r.randint(0, 150)), r.choice(["failed", "failed", "failed", "done", None])))
        out.append(rows)
    return out


def simulate(parts, most=3, base=60):
    """Input of a batch comes before the timers that the batch's watermark, the largest time of the batches before, lets fire."""
    waiting, out, watermark, largest = {}, [], 0, 0
    ms = lambda t: int(t.timestamp() * 1000)
    for rows in [*parts, []]:
        watermark = largest
        for item, host, attempt, at, outcome in sorted(rows, key=lambda r: (r[3], r[0], r[2])):
            if ms(at) < watermark:
                continue
            if outcome == "done" or attempt >= most:
                waiting.pop((host, item), None)
                if outcome != "done":
                    out.append(("dead", host, item, attempt, None))
            else:
                waiting[host, item] = (attempt + 1, ms(at) + base * 1000 * 2**attempt)
            largest = max(largest, ms(at))
        for (host, item), (attempt, due) in sorted(waiting.items()):
            if due <= watermark:
                out.append(("retry", host, item, attempt, due))
                del waiting[host, item]
    return out, waiting


def write(spark, folder, rows, number):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part-{number}")


@pytest.mark.parametrize("restart", [False, True])
def test_stream_equals_the_simulation(spark, tmp_path, restart):
    source, parts = str(tmp_path / "in"), batches(4)
    sink = keyed.KeyedTable(spark, str(tmp_path / "out"), ["kind", "host", "item", "attempt", "due", "batch"], "kind string, host string, item string, attempt int, due timestamp, at timestamp, batch string")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(f"{source}/part-empty")

    def put(rows, label):
        return sink.upsert(rows.withColumn("batch", F.lit(label)), label)

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        keyed.stream_into(retries.retry_stream(stream), sink, "r", str(tmp_path / "state"), write=put).trigger(availableNow=True).start().awaitTermination()

    import time

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for number, rows in enumerate(parts):
            write(spark, source, rows, number)
            time.sleep(0.05)  # files are taken in the order of their times
            if restart:
                go()
        go()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = [(r["kind"], r["host"], r["item"], r["attempt"], r["due"] and int(r["due"].replace(tzinfo=dt.timezone.utc).timestamp() * 1000)) for r in sink.read().collect()]
    # A run ends with a batch without rows, which lets the timers fire that its last times have reached.
    want, _ = simulate([x for rows in parts for x in (rows, [])] if restart else parts)
    assert sorted(set(map(str, got))) == sorted(set(map(str, want))) and any(x[0] == "retry" for x in got) and any(x[0] == "dead" for x in got)


def test_times_go_to_the_nearest_millisecond(spark, tmp_path):
    """Half a millisecond and more counts as a whole one, in due times and in the watermark; files that are not in order of time lose nothing."""
    from loomstone.plans import kept

    at = lambda us: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=us)
    rows = [(100 + 5 * k, 4, at(120_000_000 - 5_000_000 * k), "error") for k in range(18)]  # the latest time comes first
    rows += [(5, 1, at(1_500), "error"), (10, 1, at(1_499), "error"), (20, 2, at(59_999_499), "error"), (25, 2, at(60_000_500), "error"), (13, 2, at(7_600), "error"), (30, 3, at(5), "click")]
    for row in rows:
        spark.createDataFrame([row], "event_id long, user_id long, ts timestamp_ntz, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = kept.retry_timers(spark, str(tmp_path)).collect()
    base = 1_704_067_200_000
    due = {100 + 5 * k: base + 180_000 - 5_000 * k for k in range(12, 18)} | {5: base + 60_002, 10: base + 60_001, 20: base + 119_999}
    assert {(r["item"], r["due"]) for r in got if r["kind"] == "retry"} == set(due.items())
    assert [(r["item"], r["due"]) for r in got if r["kind"] == "dead"] == [(13, None)]


def test_what_waits_in_a_part_is_one_value(spark, tmp_path, parts=2):
    """Many hosts and items share a part's value and timer: rows are those of the simulation, and the state has a few rows a part, not some an item."""
    from loomstone.streaming import windows

    source, made = str(tmp_path / "in"), batches(11, 3)
    made[0] = made[0] + [(f"n{k}", f"m{k}", 2, START + dt.timedelta(seconds=800 + k), "failed") for k in range(60)]  # a host each; late to be due
    made[1:] = [[(i, h, a, at + dt.timedelta(seconds=700), o) for i, h, a, at, o in rows] for rows in made[1:]]
    for number, rows in enumerate(made):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/part-{number}")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        found = []
        for number in range(len(made)):  # each file is a run of its own, from the checkpoint of those before
            stream = spark.readStream.schema(SCHEMA).parquet(f"{source}/part-[0-{number}]")
            query = retries.retry_stream(stream, parts=parts).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda rows, _: found.extend(rows.collect())).start()
            query.awaitTermination()
            assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * parts + 2 * number
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, waiting = simulate([x for rows in made for x in (rows, [])])
    got = [(r["kind"], r["host"], r["item"], r["attempt"], r["due"] and int(r["due"].replace(tzinfo=dt.timezone.utc).timestamp() * 1000)) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, want)) and waiting and sum(r[0] == "retry" for r in got) > 60
