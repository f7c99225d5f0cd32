"""Timeline operators on streams: sliding windows, sessions, and frozen frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp, with a watermark on streams."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return own.withWatermark("ts", late) if own.isStreaming else own


def sliding(events: DataFrame, width: str = "1 hour", step: str = "48 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and errors in overlapping windows; rows later than ``late`` are dropped by the watermark."""
    own = _timed(events, late)
    return own.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Contiguous runs of a user's events: no two neighbours more than ``gap`` apart."""
    own = _timed(events, late)
    return own.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "events", "errors")


FROZEN = "user_id long, event_id long, value double, shown long"


def frozen(events: DataFrame) -> DataFrame:
    """Each event with the value last seen healthy: state carries it from batch to batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, shown = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            if r.event_type != "error":
                value, shown = float(r.value), int(r.event_id)
            out.append((key[0], r.event_id, value, shown))
        state.update((value, shown))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "value", "shown"]).astype({"value": "float64", "shown": "Int64"})

    own = events.select("user_id", "event_id", "ts", "event_type", "value")
    return own.groupBy("user_id").applyInPandasWithState(step, FROZEN, "value double, shown long", "append", GroupStateTimeout.NoTimeout)
