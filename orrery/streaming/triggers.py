"""Continuous re-analysis: change triggers, throttling, windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.session import ship_package

#: The least and the usual time between two triggers.
MIN_DEBOUNCE_MS, DEBOUNCE_MS = 250, 3000
TRIGGER = "project string, at timestamp, n_changes long"


def leading_edge(times: list[int], last: int | None, pending: int, debounce: int) -> tuple[list[tuple[int, int]], int | None, int]:
    """Throttle sorted event times (ms).

    An event fires at once if the last trigger is at least ``debounce`` ago, else it waits
    and joins the next trigger, which fires when that time has passed.  Returns the
    triggers (time, changes), the last trigger's time and the number of waiting changes.
    """
    out: list[tuple[int, int]] = []
    for t in times:
        if pending and last is not None and t >= last + debounce:
            last = last + debounce
            out.append((last, pending))
            pending = 0
        if last is None or t >= last + debounce:
            out.append((t, 1))
            last = t
        else:
            pending += 1
    return out, last, pending


def throttle(changes: DataFrame, debounce_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Triggers of a stream ``(project, ts)``; ``ts`` needs a watermark set by the caller."""
    debounce = max(debounce_ms, MIN_DEBOUNCE_MS)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pending = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            out, last, pending = ([(last + debounce, pending)] if pending else []), last + debounce if pending else last, 0
            state.update((last, pending))
        else:
            times = sorted(int(t.timestamp() * 1000) for b in batches for t in b["ts"])
            out, last, pending = leading_edge(times, last, pending, debounce)
            state.update((last, pending))
            if pending:
                state.setTimeoutTimestamp(max(last + debounce, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"project": [key[0]] * len(out), "at": [pd.Timestamp(t, unit="ms") for t, _ in out], "n_changes": [n for _, n in out]})

    ship_package(changes.sparkSession)
    return changes.groupBy("project").applyInPandasWithState(run, TRIGGER, "last long, pending long", "append", GroupStateTimeout.EventTimeTimeout)


def reanalyse(triggers: DataFrame, analyse: Callable[[str], None], checkpoint_path: str) -> StreamingQuery:
    """Run ``analyse(project)`` once for each project of every micro-batch, until the input is used up."""

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.select("project").distinct().toLocalIterator():
            analyse(row["project"])

    return triggers.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by type and window; rows later than ``late`` are not waited for."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n")
    )


def latest_progress(progress: DataFrame) -> DataFrame:
    """The last status of every rule: ``(rule_id, status, seq)``."""
    return progress.groupBy("rule_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
