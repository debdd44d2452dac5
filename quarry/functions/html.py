"""Titles and images of pages, read by the parser of `markup`, and addresses as expressions."""

from __future__ import annotations

from html import unescape

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import each, image_sources_of, title_of, with_sources


def title(html: Column | str) -> Column:
    """Text of the page's title; null without one."""
    return each(title_of, "string", html)


def image_sources(html: Column | str) -> Column:
    """Values of src of all images, in order; null for null."""
    return each(image_sources_of, "array<string>", html)


def _rewritten(page: str, names: list[str], targets: list[str]) -> str:
    return with_sources(page, dict(zip(names, targets, strict=True))) if names else page


def with_image_sources(html: Column | str, names: Column, targets: Column) -> Column:
    """The pages with each image source in `names` replaced by the one of the same place in `targets`."""
    return each(_rewritten, "string", html, names, targets)


def unescaped(text: Column | str) -> Column:
    """Text with its character references resolved."""
    return each(unescape, "string", text)


def absolute(src: Column, base: Column | str) -> Column:
    """src resolved against the page's URL; null where that gives no http address."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)//", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/)", 1)
    folder = F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/")))
    url = F.when(src.rlike(r"(?i)^https?://"), src).when(src.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None)).when(src.startswith("//"), F.concat(scheme, src)).when(src.startswith("/"), F.concat(origin, src)).otherwise(F.concat(folder, src))
    return F.when((src != "") & (origin != ""), url)
