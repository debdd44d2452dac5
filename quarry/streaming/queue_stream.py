"""Structured Streaming forms of the queues: latest task state, drained queues, limited attempts, facets by time.

Stateful forms sort the events that one key has in one micro-batch, which bounds
what a task holds; the source's rate limit sets the size of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limiter import LIMIT, WINDOW_S, Window


def facets_by_time(tasks: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """status counts per event-time window; rows later than the watermark are left out."""
    timed = tasks.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", window), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def latest_state(events: DataFrame) -> DataFrame:
    """task_id, status, retries: the state after each batch of task events (task_id, at, failed); the last event decides.

    A failure counts a retry, and the sixth failure is final.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        retries, status = state.get if state.exists else (0, "pending")
        rows = pd.concat(list(batches)).sort_values("at")  # events of one task in one batch
        for failed in rows["failed"]:
            if status in ("done", "fail"):
                break
            retries, status = (retries + 1, "pending" if retries < 5 else "fail") if failed else (0, "done")
        state.update((retries, status))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "retries": [retries]})

    return events.groupBy("task_id").applyInPandasWithState(update, "task_id string, status string, retries int", "retries int, status string", "update", GroupStateTimeout.NoTimeout)


def limited(attempts: DataFrame, limit: int = LIMIT, window_s: float = WINDOW_S) -> DataFrame:
    """The attempt limiter over a stream: attempts (key, seq, at, success) with their decisions."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        window = Window(start, count)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        allowed = []
        for row in rows.itertuples(index=False):
            allowed.append(window.attempt(row.at, limit, window_s)[0])
            if row.success and allowed[-1]:
                window.reset()
        state.update((window.start, window.count))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(), "allowed": allowed})

    return attempts.groupBy("key").applyInPandasWithState(update, "key string, seq long, allowed boolean", "start double, count int", "append", GroupStateTimeout.NoTimeout)


def drain(source: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Work through all that is there, batch by batch, then stop; a failed batch is delivered again."""
    return source.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(source: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str = "300 seconds"):
    """Like drain, and again whenever the time has come."""
    return source.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
