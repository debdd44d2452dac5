"""Changes of tables as functions from snapshots to snapshots.

Parquet tables have no row updates, so a change is a new snapshot that the
caller writes; one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import bookmark_id, canonical_url, domain
from ..schema import DONE, PENDING
from .predicates import blank
from .tags import appended, normalized


class DuplicateError(ValueError):
    pass


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row per key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key; `new` holds a key once."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Deletes the keys from every table that has them as columns."""
    return {name: delete(df, gone, keys) if set(keys) <= set(df.columns) else df for name, df in tables.items()}


def new_bookmarks(old: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and refused rows: a tenant has a canonical URL once, the earliest of a batch wins; URLs without a host are refused."""
    incoming = incoming.withColumns({"canonical_url": canonical_url("url"), "domain": domain("url"), "tags": normalized("tags")})
    known = old.select("user_id", canonical_url("url").alias("canonical_url")).distinct().withColumn("_known", F.lit(True))
    order = Window.partitionBy("user_id", "canonical_url").orderBy("created_at", "url")
    judged = incoming.withColumn("_n", F.row_number().over(order)).join(known, ["user_id", "canonical_url"], "left")
    ok = F.col("canonical_url").isNotNull() & (F.col("_n") == 1) & F.col("_known").isNull()
    accepted = judged.where(ok).drop("_n", "_known").withColumn("bookmark_id", bookmark_id("canonical_url"))
    return accepted, judged.where(~ok).drop("_n", "_known")


def collisions(bookmarks: DataFrame) -> DataFrame:
    """user_id, canonical_url, n of URLs that a tenant holds more than once."""
    named = bookmarks.select("user_id", canonical_url("url").alias("canonical_url"))
    return named.groupBy("user_id", "canonical_url").agg(F.count("*").alias("n")).where("n > 1")


def check_collisions(bookmarks: DataFrame) -> None:
    row = collisions(bookmarks).orderBy("user_id", "canonical_url").first()
    if row:
        raise DuplicateError(f"user {row['user_id']} has {row['canonical_url']} {row['n']} times")


def _text_ai_status(summary: Column, tags: Column) -> Column:
    return F.when((summary == DONE) & (tags == DONE), F.lit(DONE)).otherwise(F.lit(PENDING))


def update_tags(bookmarks: DataFrame, changes: DataFrame, mode: str = "set") -> DataFrame:
    """changes: user_id, bookmark_id, new_tags.  set replaces, append unites; the statuses follow."""
    keys = ["user_id", "bookmark_id"]
    joined = bookmarks.join(changes.select(*keys, "new_tags", F.lit(True).alias("_hit")), keys, "left")
    value = normalized("new_tags") if mode == "set" else appended("tags", "new_tags")
    hit = F.coalesce("_hit", F.lit(False))
    out = joined.withColumn("tags", F.when(hit, value).otherwise(F.col("tags")))
    if "tag_status" in bookmarks.columns:
        status = F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, F.lit(DONE)).otherwise(F.lit(PENDING))
        out = out.withColumn("tag_status", F.when(hit, status).otherwise(F.col("tag_status")))
        out = out.withColumn("text_ai_status", F.when(hit, _text_ai_status(F.col("summary_status"), F.col("tag_status"))).otherwise(F.col("text_ai_status")))
    return out.select(*bookmarks.columns)


def update_summary(bookmarks: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: user_id, bookmark_id, new_summary; a blank one is null, and its status pending."""
    keys = ["user_id", "bookmark_id"]
    joined = bookmarks.join(changes.select(*keys, "new_summary", F.lit(True).alias("_hit")), keys, "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = joined.withColumn("summary", F.when(hit, F.when(~blank("new_summary"), F.col("new_summary"))).otherwise(F.col("summary")))
    if "summary_status" in bookmarks.columns:
        status = F.when(F.col("summary").isNotNull(), F.lit(DONE)).otherwise(F.lit(PENDING))
        out = out.withColumn("summary_status", F.when(hit, status).otherwise(F.col("summary_status")))
        out = out.withColumn("text_ai_status", F.when(hit, _text_ai_status(F.col("summary_status"), F.col("tag_status"))).otherwise(F.col("text_ai_status")))
    return out.select(*bookmarks.columns)


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the bookmarks that `new` names give way to the new ones."""
    keys = ["user_id", "bookmark_id"]
    return delete(old, new, keys).unionByName(new)


def ai_output(rows: DataFrame) -> DataFrame:
    """rows: summary, tags, new_summary, new_tags, needs_summary, needs_tags, has_chunks.  What was asked for is taken, the rest stays."""
    make = lambda need: F.col(need) & F.col("has_chunks")
    summary = F.when(make("needs_summary"), F.when(~blank("new_summary"), F.col("new_summary"))).otherwise(F.col("summary"))
    return rows.withColumns({"summary": summary, "tags": F.when(make("needs_tags"), normalized("new_tags")).otherwise(F.col("tags"))})


def new_users(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """Users whose trimmed lower-case name is free, the earliest of a batch first."""
    name = F.lower(F.trim("username"))
    named = first_of(incoming.withColumn("_name", name), ["_name"], "created_at", "user_id")
    return named.join(old.select(name.alias("_name")).distinct(), "_name", "left_anti").drop("_name")
