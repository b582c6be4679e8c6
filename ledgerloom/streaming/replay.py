"""Micro-batch forms of event checks (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts per window and event type; events later than ``late`` are dropped by the watermark."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "n")


def budgeted_replay_stream(events: DataFrame, budget: int, terminal: str = "error", idle_minutes: int | None = None) -> DataFrame:
    """(user_id, reads, outcome) once a user's replay ends; the state is two numbers per user, whatever the history.

    Within a micro-batch events are read in order of event_id, as in the batch form. With ``idle_minutes``, a user
    without events for that long (in event time) ends: one whose replay is open has 'insufficient_material', and the
    state of every ended user is removed. Without, the state of a user stays for good.
    """

    def step(key, frames: Iterator[pd.DataFrame], state):
        reads, done = state.get if state.exists else (0, False)
        out = []
        if state.hasTimedOut:
            state.remove()
            if not done:
                out.append((key[0], reads, "insufficient_material"))
        else:
            rows = pd.concat(list(frames)).sort_values("event_id")
            for kind in rows["event_type"]:
                if done:
                    break
                reads += 1
                if kind == terminal or reads == budget:
                    done = True
                    out.append((key[0], reads, "finish" if kind == terminal else "budget_exhausted"))
            state.update((reads, done))
            if idle_minutes is not None:
                last = int(pd.Timestamp(rows["ts"].max()).timestamp() * 1000)
                state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_minutes * 60_000 + 1)
        yield pd.DataFrame(out, columns=["user_id", "reads", "outcome"])

    timed = events if idle_minutes is None else events.withWatermark("ts", "0 seconds")
    timeout = "NoTimeout" if idle_minutes is None else "EventTimeTimeout"
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, reads bigint, outcome string", "reads bigint, done boolean", "append", timeout)
