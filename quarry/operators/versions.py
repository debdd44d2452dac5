"""Versions of the data model: steps that bring snapshots from one version to the next, and the checks around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from ..schema import DONE, PENDING
from .mutations import check_collisions

Tables = dict[str, DataFrame]


def current(versions: DataFrame) -> int:
    """The highest version, 0 where there is none."""
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]


def migrate(tables: Tables, version: int, steps: Sequence[tuple[int, Callable[[Tables], Tables]]]) -> tuple[Tables, int]:
    """Applies the steps above the version in order."""
    for number, step in sorted(steps, key=lambda s: s[0]):
        if number > version:
            tables, version = step(tables), number
    return tables, version


def lower_case_tags(df: DataFrame) -> DataFrame:
    """Distinct lower-case tags without blanks around them, sorted; none are null."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t != "")))
    return df.withColumn("tags", F.when(F.size(clean) > 0, clean))


def backfill_canonical_urls(bookmarks: DataFrame) -> DataFrame:
    """canonical_url where it is missing; an error if a tenant then has one twice."""
    filled = bookmarks.withColumn("canonical_url", F.coalesce("canonical_url", canonical_url("url")))
    check_collisions(filled)
    return filled


def reset_derived(tables: Tables, now: datetime) -> Tables:
    """Derived data is made anew: no chunks, no summaries or tags, all background jobs pending."""
    b = tables["bookmark"]
    long = F.coalesce(F.length("text_content"), F.lit(0)) >= 200
    values = {"summary": F.lit(None).cast("string"), "tags": F.lit(None).cast("array<string>"), "summary_status": F.lit(PENDING), "tag_status": F.lit(PENDING), "updated_at": F.lit(now)}
    for kind, status in (("text_ai", F.lit(PENDING)), ("embedding", F.when(long, F.lit(PENDING)).otherwise(F.lit(DONE)))):
        values |= {f"{kind}_status": status, f"{kind}_attempts": F.lit(0), f"{kind}_next_attempt_at": F.lit(now), f"{kind}_fail_reason": F.lit(None).cast("string"), f"{kind}_pipeline_version": F.lit(1)}
    emptied = {name: tables[name].limit(0) for name in ("bookmark_chunk", "bookmark_ai_chunk") if name in tables}
    return tables | emptied | {"bookmark": b.withColumns(values)}


#: Field, message and the rule that a new account breaks.
SIGN_UP_RULES = (
    ("username", "username must not be empty", "username rlike '^\\\\s*$'"),
    ("password", "password must not be empty", "password rlike '^\\\\s*$'"),
    ("password", "password must be at least 8 characters", "password rlike '\\\\S' and length(password) < 8"),
    ("password", "password confirmation should match", "not password <=> confirmation"),
)


def sign_up_errors(accounts: DataFrame) -> DataFrame:
    """accounts: username, password, confirmation.  Adds errors: the field and message of every rule that the account breaks."""
    broken = [F.when(F.expr(rule), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for field, message, rule in SIGN_UP_RULES]
    return accounts.withColumn("errors", F.filter(F.array(*broken), lambda e: e.isNotNull()))


def user_named(users: DataFrame, name: str) -> DataFrame:
    """The user of a name, whatever its case and the white space around it."""
    return users.where(F.lower("username") == name.strip().lower())
