"""Queues as state with timers: leases that run out, retries that come due, tasks that are forgotten.

Events wait in a list until the watermark has passed them, so each task's come
in the order of their times however late they arrive; a timer at every event's
time wakes them.  A task's state is one row.  A second timer stands at the end
of its lease, and when a task is over a third one removes it, so the state
store holds what is open and what ended recently, and nothing else.

The session needs a state store with timers (`STATE_STORE`).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.limiter import LIMIT, WINDOW_S, Window
from ..operators.queues import TASK_LEASE_S, TASK_RETRIES
from ..schema import DONE, FAIL, PENDING

#: Setting and value that a session with these streams needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
NEW, DELIVER, FAILED = "new", "deliver", "failed"
DELIVERIES = "task_id string, at timestamp, action string, retries int, deliveries int, released timestamp"
DECISIONS = "key string, seq long, at timestamp, allowed boolean, retry_after long, released timestamp"


def _ms(at: datetime) -> int:
    return int((at.timestamp() if at.tzinfo else at.astimezone().timestamp()) * 1000)


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


class InOrder(StatefulProcessor):
    """Gives a key's events, rows of `waits`, to `event` in the order of their times, and its timers to `timer`."""

    waits: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"ms long, {self.waits}")

    def values(self, row: Row) -> tuple:
        raise NotImplementedError

    def event(self, key: str, ms: int, *values) -> Iterator[Row]:
        raise NotImplementedError

    def timer(self, key: str, ms: int) -> Iterator[Row]:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            ms = _ms(row["at"])
            self.waiting.appendValue((ms, *self.values(row)))
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        # What is known only now counts, for operators that follow, as after the watermark.
        self.released = _at(timerValues.getCurrentWatermarkInMs() + 1)
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        later = [x for x in held if x[0] > now]
        if len(later) < len(held):
            self.waiting.put(later) if later else self.waiting.clear()
        for ms, *values in held[: len(held) - len(later)]:
            yield from self.event(key[0], ms, *values)
        yield from self.timer(key[0], now)

    def close(self) -> None:
        pass


class TaskQueue(InOrder):
    """Deliveries and ends of tasks."""

    waits = "kind string"

    def __init__(self, lease_s: float, retries: int, backoff_s: tuple[float, ...], keep_s: float) -> None:
        self.lease, self.retries, self.backoff, self.keep = int(lease_s * 1000), retries, [int(s * 1000) for s in backoff_s], int(keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # due: when an open task is delivered again, when one that is over is forgotten.
        self.task = handle.getValueState("task", "status string, retries int, deliveries int, due long")

    def values(self, row: Row) -> tuple:
        return (row["kind"],)

    def _set(self, key: str, ms: int, action: str, status: str, retries: int, deliveries: int, due: int) -> Iterator[Row]:
        self.task.update((status, retries, deliveries, due))
        self.handle.registerTimer(due)
        yield Row(task_id=key, at=_at(ms), action=action, retries=retries, deliveries=deliveries, released=self.released)

    def event(self, key: str, ms: int, kind: str) -> Iterator[Row]:
        if not self.task.exists():
            # An outcome of a task that is not known, or no more, says nothing.
            if kind == NEW:
                yield from self._set(key, ms, DELIVER, PENDING, 0, 1, ms + self.lease)
            return
        status, retries, deliveries, due = self.task.get()
        if status != PENDING or kind == NEW:
            return
        if kind == DONE:
            yield from self._set(key, ms, DONE, DONE, retries, deliveries, ms + self.keep)
        elif retries >= self.retries:
            yield from self._set(key, ms, FAIL, FAIL, retries, deliveries, ms + self.keep)
        else:
            # Without a backoff it waits for the end of its lease.
            wait = ms + self.backoff[min(retries, len(self.backoff) - 1)] if self.backoff else due
            self.task.update((PENDING, retries + 1, deliveries, wait))
            self.handle.registerTimer(wait)

    def timer(self, key: str, ms: int) -> Iterator[Row]:
        if not self.task.exists():
            return
        status, retries, deliveries, due = self.task.get()
        if due > ms:
            return  # a lease that was renewed, or a timer of an event
        if status == PENDING:
            yield from self._set(key, ms, DELIVER, PENDING, retries, deliveries + 1, ms + self.lease)
        else:
            self.task.clear()


def _queue(timed: DataFrame, lease_s: float = TASK_LEASE_S, retries: int = TASK_RETRIES, backoff_s: tuple[float, ...] = (), keep_s: float = 86_400) -> DataFrame:
    return timed.groupBy("task_id").transformWithState(TaskQueue(lease_s, retries, backoff_s, keep_s), DELIVERIES, "Append", "EventTime", eventTimeColumnName="released")


def _timed(events: DataFrame, late: str) -> DataFrame:
    rows = events.select("task_id", F.col("at").cast("timestamp").alias("at"), "kind")
    return rows.withColumn("released", F.col("at")).withWatermark("released", late)


def deliveries(events: DataFrame, late: str = "10 minutes", **queue) -> DataFrame:
    """events: task_id, at (timestamp), kind (new, done or failed).  task_id, at, action (deliver, done or fail), retries, deliveries, released.

    A new task is delivered at once, and again whenever its lease (`lease_s`),
    or the wait after a failure (`backoff_s`, by number of failures), has passed
    without an outcome.  The failure after `retries` others is final.  A task
    that is over is known for `keep_s`, so that one sent again is not delivered
    again.  `at` is when something was due, `released` the watermark that let it
    be known.
    """
    return _queue(_timed(events, late), **queue)


def chained(outputs: DataFrame, outcomes: DataFrame, late: str = "10 minutes", **queue) -> DataFrame:
    """The queue that follows another one: what that has done is new here; `outcomes` (task_id, at, kind) are this queue's own."""
    new = outputs.where(F.col("action") == DONE).select("task_id", "at", F.lit(NEW).alias("kind"), "released")
    return _queue(new.unionByName(_timed(outcomes, late)), **queue)


class AttemptLimiter(InOrder):
    waits = "seq long, success boolean"

    def __init__(self, limit: int, window_s: float) -> None:
        self.limit, self.window_s = limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "start double, count int")

    def values(self, row: Row) -> tuple:
        return row["seq"], bool(row["success"])

    def event(self, key: str, ms: int, seq: int, success: bool) -> Iterator[Row]:
        window = Window(*self.open.get()) if self.open.exists() else Window()
        allowed, wait = window.attempt(ms / 1000, self.limit, self.window_s)
        if success and allowed:
            self.open.clear()
        else:
            self.open.update((window.start, window.count))
            self.handle.registerTimer(int((window.start + self.window_s) * 1000))
        yield Row(key=key, seq=seq, at=_at(ms), allowed=allowed, retry_after=wait, released=self.released)

    def timer(self, key: str, ms: int) -> Iterator[Row]:
        # A window that has ended says no more than none.
        if self.open.exists() and self.open.get()[0] + self.window_s <= ms / 1000:
            self.open.clear()
        return iter(())


def limited(attempts: DataFrame, limit: int = LIMIT, window_s: float = WINDOW_S, late: str = "10 minutes") -> DataFrame:
    """The attempt limiter: attempts (key, seq, at, success) with allowed and retry_after; a key's state ends with its window."""
    timed = attempts.select("key", "seq", F.col("at").cast("timestamp").alias("at"), "success").withWatermark("at", late)
    return timed.groupBy("key").transformWithState(AttemptLimiter(limit, window_s), DECISIONS, "Append", "EventTime", eventTimeColumnName="released")
