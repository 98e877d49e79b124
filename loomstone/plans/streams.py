"""Streaming plans over the events table, run once over all there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows
from .registry import Registry

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL


@R.frame("Y2_hourly_stream", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS calls, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def hourly(spark, d):
    found = windows.run_once(windows.hourly(windows.event_stream(spark, f"{d}/events.parquet")), "complete")
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "event_type", "calls", "least", "most")


@R.frame("Y11_sliding_stream", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * back) AS bucket, event_type, count(*) AS calls FROM events, (VALUES (0), (1)) v(back) GROUP BY 1, 2")
def sliding(spark, d):
    found = windows.run_once(windows.sliding(windows.event_stream(spark, f"{d}/events.parquet")), "complete")
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "event_type", "calls")


@R.frame("Y5_dedup_stream", "SELECT DISTINCT user_id, event_type FROM events")
def dedup(spark, d):
    e = windows.event_stream(spark, f"{d}/events.parquet")
    return windows.run_once(windows.first_of_key(e, ["user_id", "event_type"], "3650 days"), "append").select("user_id", "event_type")


@R.frame("Y10_session_stream", "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, min(ts) AS began, count(*) AS calls FROM s GROUP BY user_id, n")
def sessions(spark, d):
    found = windows.run_once(windows.sessions(windows.event_stream(spark, f"{d}/events.parquet")), "complete")
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("began"), "calls")


_CLOSED = "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS calls FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2"


@R.frame("Y4_window_close", _CLOSED)
def closed(spark, d):
    """Hours that the watermark has passed come out once, when they close; open ones do not."""
    found = windows.run_once(windows.hourly(windows.event_stream(spark, f"{d}/events.parquet")), "append")
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "event_type", "calls")


@R.frame("Y3_late_bound", f"SELECT bucket, sum(calls) AS calls FROM ({_CLOSED}) GROUP BY bucket".replace("sum(calls)", "CAST(sum(calls) AS BIGINT)"))
def late_bound(spark, d):
    """Calls of the hours whose state has gone."""
    return closed(spark, d).groupBy("bucket").agg(F.sum("calls").alias("calls"))


@R.frame("Y6_near_state")
def near_state(spark, d):
    """Events with a fingerprint near to an earlier one's within an hour."""
    e = windows.event_stream(spark, f"{d}/events.parquet").select(F.col("event_id").alias("id"), "ts", F.xxhash64("event_type", F.floor("value")).alias("fp"))
    return windows.run_once(windows.near_seen(e, keep="1 hours"), "append").groupBy("id").agg(F.max("near").alias("near"))
