"""Streams: current feedback, sessions with time to live, windows over events (STR-04, STR-06, extensions)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.feedback import current_feedback, valid_event


def current_feedback_stream(events: DataFrame) -> DataFrame:
    """The current-state view of a stream of events, for the update or complete mode (STR-06): state per message only."""
    return current_feedback(events.filter(valid_event()))


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events and their values per window and key; rows later than ``late`` are dropped by the watermark."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    marked = events.withWatermark(time, late) if events.isStreaming else events
    grouped = marked.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n_events", "total")


def session_windows(events: DataFrame, time: str = "ts", gap: str = "60 minutes", key: str = "user_id") -> DataFrame:
    """Sessions of a key that end after a gap (STR-04 in batch)."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    marked = events.withWatermark(time, gap) if events.isStreaming else events
    return marked.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def sessions_with_ttl(messages: DataFrame, minutes: int = 60, keep: int = 50) -> DataFrame:
    """Sessions as a stateful stream (STR-04, STR-05): each holds its last ``keep`` messages, and ends when nothing came for
    ``minutes`` of event time. Emits ``(session_id, n_messages, last_content, expired)``.

    ``messages``: ``session_id, ts, content`` with a watermark on ``ts``.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "n_messages": [len(held)], "last_content": [held[-1] if held else None], "expired": [True]})
            return
        latest = 0
        for b in batches:
            b = b.sort_values("ts", kind="stable")
            held = (held + b["content"].tolist())[-keep:]
            latest = max(latest, int(b["ts"].max().timestamp() * 1000))
        state.update((held,))
        state.setTimeoutTimestamp(max(latest + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "n_messages": [len(held)], "last_content": [held[-1] if held else None], "expired": [False]})

    return messages.groupBy("session_id").applyInPandasWithState(step, "session_id string, n_messages int, last_content string, expired boolean", "held array<string>", "append", GroupStateTimeout.EventTimeTimeout)
