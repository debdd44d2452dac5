"""Tag arrays and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space around a tag.
_EDGES = r"(?U)^\s+|\s+$"


def _or_null(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, tags)


def normalized(tags: Column | str) -> Column:
    """Trimmed, lower-case, without blanks, each once in order of first occurrence; nothing left is null."""
    clean = F.transform(tags, lambda t: F.lower(F.regexp_replace(t, _EDGES, "")))
    return _or_null(F.array_distinct(F.filter(clean, lambda t: t != "")))


def appended(old: Column | str, new: Column | str) -> Column:
    """Union of the old tags and the new ones, of which only the new are normalized; nothing is null."""
    none = F.array().cast("array<string>")
    return _or_null(F.array_union(F.coalesce(old, none), F.coalesce(normalized(new), none)))


def without_blanks(tags: Column | str) -> Column:
    """Tags of a new task: only blanks go."""
    return F.filter(tags, lambda t: F.regexp_replace(t, _EDGES, "") != "")


def listed(text: Column | str) -> Column:
    """Comma-separated text as sorted distinct tags."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")))


def facets(df: DataFrame, tags: str = "tags") -> DataFrame:
    """tag, n: rows per tag; map-side combine keeps the shuffle at one row per tag and task."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def sorted_facets(df: DataFrame, needle: str = "") -> DataFrame:
    """Facets whose tag contains the needle, whatever the case, most frequent first."""
    found = facets(df)
    if needle:
        found = found.where(F.lower("tag").contains(needle.lower()))
    return found.orderBy(F.desc("n"), "tag")


def merged(df: DataFrame, keys: list[str], tags: str = "tags") -> DataFrame:
    """Sorted distinct tags of all rows of a key."""
    return df.select(*keys, F.explode(tags).alias("tag")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
