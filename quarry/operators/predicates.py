"""Filter builders."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(parts: Iterable[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


@dataclass(frozen=True)
class TagFilter:
    """kind: and, or, any or untagged."""

    kind: str = "any"
    tags: tuple[str, ...] = ()

    def column(self, tags: str = "tags") -> Column:
        """Null tags meet neither and nor or; an empty `and` meets every row with tags, an empty `or` none."""
        wanted = F.array(*[F.lit(t) for t in self.tags]).cast("array<string>")
        if self.kind == "and":
            return F.col(tags).isNotNull() & (F.size(F.array_except(wanted, tags)) == 0)
        if self.kind == "or":
            return F.coalesce(F.arrays_overlap(tags, wanted), F.lit(False))
        if self.kind == "untagged":
            return F.coalesce(F.size(tags), F.lit(0)) <= 0
        if self.kind == "any":
            return F.lit(True)
        raise ValueError(f"unknown tag filter: {self.kind}")


def tool_tag_filter(kind: str | None, tags: Sequence[str] | None) -> TagFilter:
    """The tool interface: without tags it is any, whatever was asked for; case is kept."""
    if tags is None:
        return TagFilter()
    if kind not in (None, "and", "or", "any", "untagged"):
        raise ValueError(f"unknown tag filter: {kind}")
    return TagFilter(kind or "and", tuple(tags))


def api_tag_filter(kind: str, tags: Sequence[str] = ()) -> TagFilter:
    """The request interface: case is folded, white space is kept."""
    return TagFilter(kind, tuple(t.lower() for t in tags))


def has_tag(tag: str, tags: str = "tags") -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def url_like(part: str, url: str = "url") -> Column:
    """Case matters, and % and _ in the part are wildcards."""
    return F.col(url).like(f"%{part}%")


def between(column: str, start=None, end=None) -> Column:
    """Both ends included; an end left out does not bound."""
    parts = [F.col(column) >= F.lit(start)] if start is not None else []
    return all_of(parts + ([F.col(column) <= F.lit(end)] if end is not None else []))


def long_enough(text: str = "text_content", least: int = 200, unit: str = "chars") -> Column:
    """The gate for embedding, in characters or in bytes; the two differ outside ASCII."""
    return (F.length(text) if unit == "chars" else F.octet_length(text)) >= least


def blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)), F.lit("")) == ""
