"""Attempt limiter: a window that starts with a key's first attempt.

Neither a tumbling nor a session window fits, as each window is anchored where
the last one ended; so attempts are folded in time order per key, streaming
through a sorted partition with one key's state in memory.  A decision depends
on all earlier ones of its key, so a key is one task's work, however often it
tries; that task streams and needs no more memory for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

LIMIT, WINDOW_S = 5, 300


@dataclass
class Window:
    """State of one key."""

    start: float | None = None
    count: int = 0

    def attempt(self, at: float, limit: int, window_s: float) -> tuple[bool, int]:
        """(allowed, seconds to wait); a denied attempt does not count."""
        if self.start is None or at - self.start >= window_s:
            self.start, self.count = at, 0
        if self.count >= limit:
            return False, max(1, int(self.start + window_s - at))
        self.count += 1
        return True, 0

    def reset(self) -> None:
        self.start, self.count = None, 0


def decisions(attempts: DataFrame, limit: int = LIMIT, window_s: float = WINDOW_S) -> DataFrame:
    """attempts: key string, seq long, at double (seconds), success boolean.  Adds allowed and retry_after; a success resets its key."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, window = None, Window()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.key != key:
                    key, window = row.key, Window()
                out.append(window.attempt(row.at, limit, window_s))
                if row.success and out[-1][0]:
                    window.reset()
            yield batch.assign(allowed=[o[0] for o in out], retry_after=[o[1] for o in out])

    ordered = attempts.select("key", "seq", "at", "success").repartition("key").sortWithinPartitions("key", "at", "seq")
    return ordered.mapInPandas(fold, "key string, seq long, at double, success boolean, allowed boolean, retry_after long")
