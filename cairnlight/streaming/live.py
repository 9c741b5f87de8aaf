"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_captures(capture: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each query once within the watermark. capture: ts (timestamp), query, file."""
    return capture.withWatermark("ts", within).dropDuplicatesWithinWatermark(["query"])


def live_streaks(feedback: DataFrame) -> DataFrame:
    """node_id, outcome, streak after every batch. feedback: id, node_id, verdict; ids grow."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        outcome, streak = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("id")
        for verdict in rows["verdict"]:
            outcome, streak = verdict, streak + 1 if verdict == outcome else 1
        state.update((outcome, streak))
        yield pd.DataFrame({"node_id": [key[0]], "outcome": [outcome], "streak": [streak]})

    return feedback.groupBy("node_id").applyInPandasWithState(step, "node_id long, outcome string, streak long", "outcome string, streak long", "update", GroupStateTimeout.NoTimeout)


def dispatch_batches(handlers: DataFrame, foreground: Callable[[DataFrame], None], background: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: foreground handlers first, then the background ones. handlers: event, matcher, ordinal, output, background."""
    from ..operators.reconcile import dispatched

    def batch(events: DataFrame, _: int) -> None:
        foreground(dispatched(events, handlers.where("not background")))
        background(dispatched(events, handlers.where("background")))

    return batch


def windowed_verdicts(feedback: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Verdicts by window of event time. feedback: ts, verdict."""
    return feedback.withWatermark("ts", late).groupBy(F.window("ts", window), "verdict").agg(F.count("*").alias("n"))
