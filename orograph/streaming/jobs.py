"""Job events as streams: status, counts by time window, sessions, and a bounded log tail."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TAIL = 200


def stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, *, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and errors per time window; rows later than ``late`` are dropped by the watermark, so state stays bounded."""
    t = stamped(events).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A job's bursts of events: sessions that a silence of ``gap`` ends."""
    t = stamped(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return t.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def log_tail(events: DataFrame, keep: int = TAIL, *, late: str = "2 hours", idle_s: int = 86_400) -> DataFrame:
    """After each batch the last ``keep`` lines of each job that has news.

    The state of a job never holds more, and goes when the watermark (``late`` behind) is ``idle_s``
    seconds past its last line; lines later than the watermark are dropped.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        lines = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        newest = state.getCurrentWatermarkMs()
        for pdf in frames:
            newest = max(newest, int(pdf["ts"].max().timestamp() * 1000))
            lines += list(zip(pdf["event_id"].tolist(), pdf["event_type"].tolist(), strict=True))
        lines = sorted(lines)[-keep:]
        ids, types = [x[0] for x in lines], [x[1] for x in lines]
        state.update((ids, types))
        state.setTimeoutTimestamp(newest + idle_s * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "lines": [len(ids)], "last_id": [ids[-1]], "status": [types[-1]]})

    return stamped(events).withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(update, "user_id long, lines long, last_id long, status string", "ids array<long>, types array<string>", "update", GroupStateTimeout.EventTimeTimeout)
