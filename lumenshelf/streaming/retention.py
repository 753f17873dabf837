"""What users were shown lately, kept on a stream and given up by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.curation import RETENTION_DAYS

_OUT = "user_id long, theme_id long, shown_at timestamp, shown long, expired boolean"


def recently_shown(impressions: DataFrame, days: int = RETENTION_DAYS, lateness: str = "1 hour") -> DataFrame:
    """user_id, theme_id, shown_at, shown, expired: a row for each pair that a batch touches, and one when it expires.

    impressions(user_id, theme_id, shown_at) is a stream. The state of a pair
    is the last time and the number of times it was shown; a timer removes it
    once the watermark is `days` past that time, and the pair comes out as
    expired. The last row of each pair so tells what a table with rows of the
    last `days` days would hold at the watermark. Rows later than `lateness`
    are left out, and so are rows without user, theme or time.
    """
    keep = days * 86_400_000

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame([(*key, pd.Timestamp(last, unit="us"), n, True)], columns=["user_id", "theme_id", "shown_at", "shown", "expired"])
            return
        last, n = state.get if state.exists else (None, 0)
        for part in rows:
            newest = int(part["shown_at"].max().value // 1000)
            last = newest if last is None else max(last, newest)
            n += len(part)
        ends = last // 1000 + keep
        if ends <= state.getCurrentWatermarkMs():
            # It came late, and is older than what is kept.
            if state.exists:
                state.remove()
            yield pd.DataFrame([(*key, pd.Timestamp(last, unit="us"), n, True)], columns=["user_id", "theme_id", "shown_at", "shown", "expired"])
            return
        state.update((last, n))
        state.setTimeoutTimestamp(ends)
        yield pd.DataFrame([(*key, pd.Timestamp(last, unit="us"), n, False)], columns=["user_id", "theme_id", "shown_at", "shown", "expired"])

    whole = impressions.where("user_id is not null and theme_id is not null and shown_at is not null")
    timed = whole.select(F.col("user_id").cast("long").alias("user_id"), F.col("theme_id").cast("long").alias("theme_id"), F.col("shown_at").cast("timestamp").alias("shown_at")).withWatermark("shown_at", lateness)
    return timed.groupBy("user_id", "theme_id").applyInPandasWithState(step, _OUT, "last long, shown long", "append", GroupStateTimeout.EventTimeTimeout)
