"""Event-time windows over the events table, in batch form (the stream form is tested against it)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows
from .registry import query


def events(t):
    return t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_event_windows(t, spark):
    return windows.tumbling(events(t)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT to_timestamp(CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 - k * 21600)::TIMESTAMP AS start, count(*) AS n FROM events, (VALUES (0), (1), (2), (3)) v(k) GROUP BY 1")
def sliding_event_windows(t, spark):
    return windows.sliding(events(t)).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def session_event_windows(t, spark):
    s = windows.sessions(events(t))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(t, spark):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
