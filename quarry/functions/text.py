"""Words and lexemes of a text, as columns; stemming runs on Arrow batches, all else as expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import stem

#: The common English stop words of the public Snowball list.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by "
    "for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits; compounds fall into their parts."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


_STOP = frozenset(STOPWORDS)


def _stem_each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda found: [" ".join(map(stem, x.split(" "))) for x in found], na_action="ignore")


def _lexeme_each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda found: ["" if w in _STOP else stem(w) for w in found], na_action="ignore")


def stems(phrases: Column) -> Column:
    """Each element of an array of words, or of words joined by blanks, with its words stemmed."""
    return F.pandas_udf(_stem_each, "array<string>")(phrases)


def lexemes(text: Column | str, language: str = "english") -> Column:
    """A lexeme per word, in order; a stop word leaves an empty place, so that distances hold.

    `simple` keeps every word as it is.
    """
    return words(text) if language == "simple" else F.pandas_udf(_lexeme_each, "array<string>")(words(text))


def joined(lexeme_array: Column) -> Column:
    """Lexemes as one string with a blank on either side of each: a phrase is a substring of it."""
    return F.concat(F.lit(" "), F.array_join(lexeme_array, " "), F.lit(" "))
