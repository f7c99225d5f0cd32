"""The streaming operators on a bounded table, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeframe.plans.registry import query, read
from tapeframe.streaming import timelines


@query(
    "W14",
    """WITH e AS (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events), w AS (SELECT event_type, value, s, unnest([s // 2880 * 2880, s // 2880 * 2880 - 2880]) AS start FROM e)
    SELECT start, start + 3600 AS stop, event_type, count(*) AS events, round(sum(value), 6) AS value FROM w WHERE s < start + 3600 GROUP BY ALL""",
)
def event_sliding_windows(spark, d):
    x = timelines.sliding(read(spark, d, "events"))
    return x.select(F.unix_timestamp("start").alias("start"), F.unix_timestamp("stop").alias("stop"), "event_type", "events", "value")


@query(
    "W4",
    """WITH e AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts) + INTERVAL 30 MINUTE))::BIGINT AS stop, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM r GROUP BY user_id, run""",
)
def event_sessions(spark, d):
    x = timelines.sessions(read(spark, d, "events"))
    return x.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("stop").alias("stop"), "events", "errors")
