"""Lease-based work queues as transitions of snapshots.

Every function takes the time as an argument and gives new rows; who applies
them decides when.  Delivery is at least once: a lease that runs out makes a
row due again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DONE, FAIL, PENDING

TASK_BATCH, TASK_LEASE_S, TASK_RETRIES = 10, 300, 5
AI_BATCH = {"text_ai": 10, "embedding": 5}
AI_LEASE_S = {"text_ai": 1800, "embedding": 900}
AI_ATTEMPTS, REASON_CHARS = 5, 2048
#: Minutes until the next attempt, by number of attempts so far; later ones wait as long as the last.
BACKOFF_MINUTES = (5, 15, 60, 360, 1440)


def later(at: Column | str | datetime, seconds: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, datetime) else at
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return (F.col(at) if isinstance(at, str) else at) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def backoff_minutes(attempts: Column | str) -> Column:
    attempts = F.col(attempts) if isinstance(attempts, str) else attempts
    return F.element_at(F.array(*map(F.lit, BACKOFF_MINUTES)), F.greatest(F.lit(1), F.least(attempts, F.lit(len(BACKOFF_MINUTES)))))


def new_tasks(requests: DataFrame) -> DataFrame:
    """requests: user_id, url, tags, created_at.  Pending tasks that are due at once; the id depends on the request alone, so one that is sent again is known."""
    key = F.md5(F.concat_ws("|", "user_id", "url", F.unix_micros("created_at").cast("string")))
    values = {"task_id": key, "status": F.lit(PENDING), "updated_at": F.col("created_at"), "next_delivery": F.col("created_at"), "retries": F.lit(None).cast("int"), "fail_reason": F.lit(None).cast("string")}
    return requests.select("user_id", "url", "tags", "created_at").withColumns(values)


def due_tasks(tasks: DataFrame, now: datetime) -> DataFrame:
    return tasks.where((F.col("status") == PENDING) & (F.col("next_delivery") <= F.lit(now)))


def claim_tasks(tasks: DataFrame, now: datetime, k: int = TASK_BATCH, lease_s: int = TASK_LEASE_S) -> tuple[DataFrame, DataFrame]:
    """The k tasks due longest, and the snapshot in which their lease runs."""
    claimed = due_tasks(tasks, now).orderBy("next_delivery", "created_at", "task_id").limit(k)
    mine = claimed.select("task_id", F.lit(True).alias("_mine"))  # k rows
    leased = tasks.join(mine, "task_id", "left").withColumn("next_delivery", F.when(F.col("_mine"), later(now, lease_s)).otherwise(F.col("next_delivery"))).drop("_mine")
    return claimed.withColumn("next_delivery", later(now, lease_s)), leased


def task_outcome(tasks: DataFrame, failed: Column, reason: Column) -> DataFrame:
    """After work: done, or pending for another of TASK_RETRIES retries, or failed for good with its reason."""
    left = F.coalesce("retries", F.lit(0)) < TASK_RETRIES
    status = F.when(~failed, F.lit(DONE)).when(left, F.lit(PENDING)).otherwise(F.lit(FAIL))
    retries = F.when(failed & left, F.coalesce("retries", F.lit(0)) + 1)
    return tasks.withColumns({"fail_reason": F.when(failed & ~left, reason), "status": status, "retries": retries.cast("int")})


def claim_ai(bookmarks: DataFrame, kind: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Due rows of a background job (text_ai or embedding) and the snapshot in which their lease runs."""
    due = (F.col(f"{kind}_status") == PENDING) & (F.col(f"{kind}_next_attempt_at") <= F.lit(now))
    claimed = bookmarks
    if kind == "text_ai":
        due = due & ((F.col("summary_status") == PENDING) | (F.col("tag_status") == PENDING))
        claimed = bookmarks.withColumns({"needs_summary": F.col("summary_status") == PENDING, "needs_tags": F.col("tag_status") == PENDING})
    claimed = claimed.where(due).orderBy(f"{kind}_next_attempt_at", "created_at", "user_id", "bookmark_id").limit(AI_BATCH[kind])
    return claimed, lease(bookmarks, claimed, kind, now)


def lease(bookmarks: DataFrame, claimed: DataFrame, kind: str, now: datetime) -> DataFrame:
    """Start or refresh the lease of claimed rows that are still pending."""
    keys = ["user_id", "bookmark_id"]
    mine = claimed.select(*keys, F.lit(True).alias("_mine"))
    held = F.coalesce("_mine", F.lit(False)) & (F.col(f"{kind}_status") == PENDING)
    column = f"{kind}_next_attempt_at"
    return bookmarks.join(mine, keys, "left").withColumn(column, F.when(held, later(now, AI_LEASE_S[kind])).otherwise(F.col(column))).drop("_mine")


def ai_failure(rows: DataFrame, kind: str, now: datetime, reason: Column) -> DataFrame:
    """One attempt more; the fifth is the last, earlier ones wait for the backoff."""
    attempts = F.coalesce(f"{kind}_attempts", F.lit(0)) + 1
    last = attempts >= AI_ATTEMPTS
    return rows.withColumns(
        {
            f"{kind}_status": F.when(last, F.lit(FAIL)).otherwise(F.lit(PENDING)),
            f"{kind}_next_attempt_at": F.when(last, F.lit(now)).otherwise(later(now, backoff_minutes(attempts) * 60)),
            f"{kind}_fail_reason": F.substring(reason, 1, REASON_CHARS),
            f"{kind}_attempts": attempts,
        }
    )


def ai_success(rows: DataFrame, kind: str, version: int) -> DataFrame:
    done = {f"{kind}_status": F.lit(DONE), f"{kind}_attempts": F.lit(0), f"{kind}_fail_reason": F.lit(None).cast("string"), f"{kind}_pipeline_version": F.lit(version)}
    if kind == "text_ai":
        done |= {"summary_status": F.lit(DONE), "tag_status": F.lit(DONE)}
    return rows.withColumns(done)


def initial_status(bookmarks: DataFrame, least: int = 200) -> DataFrame:
    """Statuses of a new bookmark: what it brings is done; long texts, by bytes, wait for an embedding."""
    summary = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.lit(DONE)).otherwise(F.lit(PENDING))
    tags = F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, F.lit(DONE)).otherwise(F.lit(PENDING))
    df = bookmarks.withColumns({"summary_status": summary, "tag_status": tags})
    both = (F.col("summary_status") == DONE) & (F.col("tag_status") == DONE)
    long = F.coalesce(F.octet_length("text_content"), F.lit(0)) >= least
    return df.withColumns({"text_ai_status": F.when(both, F.lit(DONE)).otherwise(F.lit(PENDING)), "embedding_status": F.when(long, F.lit(PENDING)).otherwise(F.lit(DONE))})


def reset_embedding(bookmarks: DataFrame, now: datetime, least: int = 200) -> DataFrame:
    """All rows anew; here the gate counts characters."""
    long = F.coalesce(F.length("text_content"), F.lit(0)) >= least
    return bookmarks.withColumns({"embedding_status": F.when(long, F.lit(PENDING)).otherwise(F.lit(DONE)), "embedding_attempts": F.lit(0), "embedding_next_attempt_at": F.lit(now), "embedding_fail_reason": F.lit(None).cast("string")})


def pacing(requests: DataFrame, at: str, spacing_s: float, keys: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """release (seconds): each request waits until `spacing_s` after the one before it was released.

    release_n = n d + max over i <= n of (t_i - i d), a running maximum.
    """
    window = Window.partitionBy(*keys).orderBy(at, *order)
    n = F.row_number().over(window)
    numbered = requests.withColumn("_n", n)
    peak = F.max(F.col(at) - F.col("_n") * spacing_s).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("release", F.col("_n") * spacing_s + peak).drop("_n")
