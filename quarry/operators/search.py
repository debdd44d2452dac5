"""The search request: a page of items, facets over all hits, and their number."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BOOKMARK_COLUMNS
from . import fts
from .headline import headline
from .paging import page
from .predicates import TagFilter
from .tags import facets


@dataclass(frozen=True)
class SearchRequest:
    query: str | None = None
    tags: TagFilter = field(default_factory=TagFilter)
    limit: int | None = None
    offset: int = 0
    language: str = "english"


@dataclass(frozen=True)
class SearchResult:
    items: DataFrame
    tags: DataFrame
    total: DataFrame


def hits(bookmarks: DataFrame, user_id: str, request: SearchRequest) -> DataFrame:
    """All rows of one tenant that the request matches; the tenant and tag filters come before any text is read."""
    found = bookmarks.where((F.col("user_id") == user_id) & request.tags.column())
    if request.query is None:
        return found.withColumn("rank", F.lit(0.0))
    return fts.search(fts.search_columns(found, request.language), fts.web_query(request.query, request.language))


def search(bookmarks: DataFrame, user_id: str, request: SearchRequest) -> SearchResult:
    found = hits(bookmarks, user_id, request)
    if request.query is None:
        items = page(found.select(*BOOKMARK_COLUMNS), F.desc("created_at"), "bookmark_id", limit=request.limit, offset=request.offset)
        items = items.withColumn("search_match", F.lit(None).cast("string"))
    else:
        top = page(found.select(*BOOKMARK_COLUMNS, "text_content", "rank"), F.desc("rank"), "bookmark_id", limit=request.limit, offset=request.offset)
        items = top.withColumn("search_match", headline("text_content", fts.web_query(request.query, request.language))).drop("text_content")
    return SearchResult(items, facets(found.select("tags")), found.agg(F.count("*").alias("total")))
