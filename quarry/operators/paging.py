"""Ordered pages.  Orders are total, so that a page is the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, HISTORY_MOST, KEYSET_PAGE = 20, 100, 25


def page(df: DataFrame, *order: Column | str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Spark keeps only the best limit + offset rows of each task."""
    limit = PAGE if limit is None else limit
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def newest_first(df: DataFrame, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    return page(df, F.desc("created_at"), F.col(key), limit=limit, offset=offset)


def keyset_page(df: DataFrame, key: str, last: str | None = None, size: int = KEYSET_PAGE) -> DataFrame:
    """The `size` rows after `last`, each with has_more: one row beyond the page is read to know."""
    rows = df if last is None else df.where(F.col(key) > last)
    probe = rows.orderBy(key).limit(size + 1)
    more = probe.agg((F.count("*") > size).alias("has_more"))
    return probe.orderBy(key).limit(size).crossJoin(more)  # one row


def history_page(df: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    return newest_first(df, "session_id", min(limit, HISTORY_MOST), offset)


def page_bounds(number: int, size: int = PAGE) -> tuple[int, int | None]:
    """limit and offset of a page counted from 1; the first has no offset."""
    number = max(1, number)
    return size, (number - 1) * size if number > 1 else None


def pages_of(total: int, size: int = PAGE) -> int:
    return -(-total // size)
