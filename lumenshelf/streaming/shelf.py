"""Shelf events as a stream: user state and history kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.activity import user_state


def hourly_click_rate(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Shown and clicked per hour of event time; rows later than the watermark are left out."""
    # A watermark needs a timestamp with a time zone; the tables hold UTC without one.
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour")).agg(
        F.count("*").alias("shown"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("hits")
    ).select(F.col("window.start").alias("hour"), "shown", "hits")


def user_totals(events: DataFrame) -> DataFrame:
    """Running likes and events of each user."""
    return events.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("likes"))


def keep_state(changes: DataFrame, shelf: Callable[[], DataFrame], as_of: Column, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Recompute the state of the users of each batch of shelf changes, and hand it to `write` with the batch's number.

    changes has user_id; `shelf` gives the shelf as it stands. Only users of
    the batch are read and written, and a batch that runs again writes the
    same rows, so `write` should replace what it wrote for that number.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        touched = batch.select("user_id").distinct()
        write(user_state(shelf().join(touched, "user_id", "left_semi"), as_of), number)

    return changes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_of(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """user_id, book_id, event_id, old, new of a stream of states(user_id, book_id, state, at, event_id): a row where a pair's state changes, nulls told apart.

    The last state of each pair is kept; batches are taken in order of `at`
    and event_id. Rows older than the watermark are left out.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, last = state.get if state.exists else (False, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples():
            new = r.state if isinstance(r.state, str) else None
            if known and new != last:
                out.append((*key, r.event_id, last, new))
            known, last = True, new
        state.update((known, last))
        yield pd.DataFrame(out, columns=["user_id", "book_id", "event_id", "old", "new"])

    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy("user_id", "book_id").applyInPandasWithState(step, "user_id long, book_id long, event_id long, old string, new string", "known boolean, last string", "append", GroupStateTimeout.NoTimeout)


def run_available(result: DataFrame, checkpoint: str, table: str, mode: str = "complete") -> StreamingQuery:
    """Process all that is there into a table in memory and stop, for tests and small results; a rerun goes on from the checkpoint."""
    return result.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
