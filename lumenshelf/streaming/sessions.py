"""Sessions: stretches of a user's events without a long pause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A longer pause ends a session.
GAP = "30 minutes"


def sessions(events: DataFrame, gap: str = GAP) -> DataFrame:
    """user_id, started, ended, events, hits of each session of events(user_id, ts, event_type).

    An event opens a session where more than `gap` has gone by since the user's
    last. `ended` is the time of the last event. Events without a user or
    time belong to none. On a stream with a watermark a session comes out
    once, when the watermark has passed its end by `gap`.
    """
    whole = events.where("user_id is not null and ts is not null")
    found = whole.groupBy("user_id", F.session_window("ts", gap)).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("hits")
    )
    return found.select("user_id", "started", "ended", "events", "hits")


def stream_sessions(events: DataFrame, gap: str = GAP, lateness: str = "2 hours") -> DataFrame:
    """sessions of a stream; rows later than `lateness` are left out."""
    # A watermark needs a timestamp with a time zone; the tables hold UTC without one.
    return sessions(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness), gap)
