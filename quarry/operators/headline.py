"""Highlights: the fragment of a text that covers a query best, its hits marked.

A cover is a shortest run of words that has every wanted word and phrase of
one alternative; excluded words play no part.  A fragment begins at a cover's
first word and holds at most `most` words.  A shorter cover is extended to the
right until the fragment has `least` words and does not end in a short word,
and to the left where the text ends before that; a longer one is cut, and
short words at the cut go while `least` words remain.  A short word has at
most SHORT characters and is no hit.  The best fragment holds its whole cover,
then the most hits, then a good end; of equals it is the first.  Without a
cover it is the first `least` words, hits marked.

Everything between the words of a fragment stays as it is.  Meant for the rows
of a page, after the top-k: the texts go through Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import STOPWORDS
from .fts import LEAST_WORDS, MOST_WORDS, WebQuery

SHORT = 3
_WORD = re.compile(r"[^\W_]+")
_STOP = frozenset(STOPWORDS)


def _occurrences(lexemes: list[str], phrase: list[str]) -> Iterator[tuple[int, int]]:
    """First and last word of each place of a phrase; an empty lexeme of it stands for any word."""
    for i in range(len(lexemes) - len(phrase) + 1):
        if all(not want or lexemes[i + j] == want for j, want in enumerate(phrase)):
            yield i, i + len(phrase) - 1


def covers(lexemes: list[str], groups: list[list[list[str]]]) -> list[tuple[int, int]]:
    """Shortest runs that hold all phrases of a group, none inside another, in order."""
    found = set()
    for group in groups:
        events = sorted((last, first, n) for n, phrase in enumerate(group) for first, last in _occurrences(lexemes, phrase))
        latest = [-1] * len(group)
        for last, first, n in events:
            latest[n] = max(latest[n], first)
            if min(latest) >= 0:
                found.add((min(latest), last))
    kept: list[tuple[int, int]] = []
    for first, last in sorted(found, key=lambda c: (c[1], -c[0])):
        if not kept or first > kept[-1][0]:
            kept.append((first, last))
    return kept


def fragment(hits: list[bool], lengths: list[int], cover: tuple[int, int], most: int, least: int) -> tuple[int, int]:
    """First and last word of the fragment of a cover."""
    n, (first, last) = len(hits), cover

    def short(i: int) -> bool:
        return lengths[i] <= SHORT and not hits[i]

    if last - first + 1 >= most:
        end = first + most - 1
        while short(end) and end - first + 1 > least:
            end -= 1
        return first, end
    limit = min(n, first + most) - 1
    good = (i for i in range(last, limit + 1) if i - first + 1 >= least and not short(i))
    end = next(good, limit)
    return max(0, min(first, end - least + 1)), end


def marked(text: str, groups: list[list[list[str]]], english: bool, most: int, least: int) -> str:
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    lexemes = [("" if w in _STOP else stem(w)) for w in words] if english else words
    wanted = {x for g in groups for phrase in g for x in phrase if x}
    hits = [x in wanted for x in lexemes]
    lengths = [b - a for a, b in spans]
    best, chosen = None, (0, min(least, len(spans)) - 1)
    for cover in covers(lexemes, groups):
        begin, end = fragment(hits, lengths, cover, most, least)
        value = (end >= cover[1], sum(hits[begin : end + 1]), hits[end] or lengths[end] > SHORT)
        if best is None or value > best:
            best, chosen = value, (begin, end)
    out, at = [], spans[chosen[0]][0] if spans else 0
    for (a, b), hit in list(zip(spans, hits, strict=True))[chosen[0] : chosen[1] + 1]:
        out += [text[at:a], f"<mark>{text[a:b]}</mark>" if hit else text[a:b]]
        at = b
    return "".join(out)


def headline(text: Column | str, query: WebQuery, most: int = MOST_WORDS, least: int = LEAST_WORDS) -> Column:
    """The marked fragment of each text; null stays null, a text without words gives an empty one."""
    wanted = [[c.lexemes(query.language) for c in g if not c.negated] for g in query.groups]
    groups = [g for g in ([x for x in g if x] for g in wanted) if g]
    english = query.language != "simple"

    def each(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else marked(t, groups, english, most, least) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(each, "string")(text)
