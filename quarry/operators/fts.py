"""Full-text search: weighted documents, web-style queries, rank and highlight.

`search_columns` adds what queries need; a table that is searched often keeps
those columns, or the postings, instead of computing them per query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import STOPWORDS, joined, lexemes
from . import rank as R

#: Words of a highlight.
MOST_WORDS, LEAST_WORDS = 35, 15
#: Rows whose postings a task makes, on average.
TASK_DOCS = 4096


def search_columns(df: DataFrame, language: str = "english") -> DataFrame:
    """Lexemes of title, body and tags; nulls are empty.  URL and summary are not searched."""
    parts = {"title_lexemes": F.col("title"), "text_lexemes": F.col("text_content"), "tag_lexemes": F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")}
    df = df.withColumns({name: lexemes(text, language) for name, text in parts.items()})
    return df.withColumn("search_text", joined(F.concat(*parts)))


def _equals(lexeme: Column):
    return lambda x: x == lexeme


def _placed(term: str, before: Column, weight: float):
    """Place, behind `before` others, and weight of a lexeme that is the term; null of any other."""
    return lambda x, i: F.when(x == F.lit(term), F.struct((i + before).alias("place"), F.lit(weight).alias("weight")))


@dataclass(frozen=True)
class Clause:
    """A word or phrase, wanted or unwanted."""

    phrase: tuple[str, ...]
    negated: bool = False

    def column(self, text: Column, language: str) -> Column:
        parts = self.lexemes(language)
        # A stop word inside a phrase stands for any word.
        found = text.contains(f" {' '.join(parts)} ") if all(parts) else text.rlike(f" {' '.join(p or '[^ ]*' for p in parts)} ")
        return ~found if self.negated else found

    def lexemes(self, language: str) -> list[str]:
        """The words' lexemes; a stop word inside leaves an empty place, one at an end none."""
        parts = list(self.phrase) if language == "simple" else ["" if w in STOPWORDS else stem(w) for w in self.phrase]
        kept = [i for i, x in enumerate(parts) if x]
        return parts[kept[0] : kept[-1] + 1] if kept else []


@dataclass(frozen=True)
class WebQuery:
    """Alternatives, each a conjunction of clauses."""

    groups: tuple[tuple[Clause, ...], ...]
    language: str = "english"

    def matches(self) -> Column:
        """Nothing left to look for matches nothing."""
        if not self.groups:
            return F.lit(False)

        def any_group(text: Column) -> Column:
            return reduce(or_, [reduce(and_, [c.column(text, self.language) for c in g]) for g in self.groups])

        # Bound as a variable, the text is made once per row, not once per clause.
        return F.exists(F.array("search_text"), any_group)

    def lexemes(self) -> list[str]:
        """Different lexemes of all clauses."""
        return sorted({x for g in self.groups for c in g for x in c.lexemes(self.language) if x})

    def operands(self) -> list[str]:
        """Different wanted lexemes: what a rank is made of."""
        return sorted({x for g in self.groups for c in g if not c.negated for x in c.lexemes(self.language) if x})

    def by_proximity(self) -> bool:
        """Whether this is one conjunction or one phrase, of several wanted lexemes."""
        return len(self.groups) == 1 and len(self.operands()) > 1

    def rank(self) -> Column:
        """Rank of a row with the search columns, from the places of the operands in title, body and tags."""
        if not self.operands():
            return F.lit(0.0)
        parts = ((F.col("title_lexemes"), "A"), (F.col("text_lexemes"), "B"), (F.col("tag_lexemes"), "C"))

        def hits(term: str) -> Column:
            """place and weight of each hit."""
            found, before = [], F.lit(0)
            for lexemes_of_part, part in parts:
                at = F.transform(lexemes_of_part, _placed(term, before, R.PART_WEIGHTS[part]))
                found.append(F.filter(at, lambda x: x.isNotNull()))
                before = before + F.size(lexemes_of_part)
            return F.concat(*found)

        if self.by_proximity():
            return R.proximity(F.array(*[F.struct(h["place"].alias("places"), h["weight"].alias("weights")) for h in map(hits, self.operands())]))

        def weights(term: str) -> Column:
            """Weights of the hits in order; their number is what a part loses without the term, so no word needs a step of its own."""
            return F.concat(*[F.array_repeat(F.lit(R.PART_WEIGHTS[part]), F.size(found) - F.size(F.array_remove(found, term))) for found, part in parts])

        return sum((R.occurrence(weights(t)) for t in self.operands()), F.lit(0.0)) / len(self.operands())


def web_query(text: str, language: str = "english") -> WebQuery:
    """Words are joined by and, "quotes" make a phrase, `or` separates alternatives, a leading - excludes.

    Other punctuation separates words; no text is an error.
    """
    groups: list[list[Clause]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if not quoted and word.lower() == "or":
            groups.append([])
            continue
        phrase = tuple(w for w in re.split(r"[\W_]+", (quoted or word).lower()) if w)
        if phrase and not (language != "simple" and all(w in STOPWORDS for w in phrase)):
            groups[-1].append(Clause(phrase, bool(minus)))
    return WebQuery(tuple(tuple(g) for g in groups if g), language)


def search(df: DataFrame, query: WebQuery) -> DataFrame:
    """Matching rows with their rank; df has the search columns."""
    return df.where(query.matches()).withColumn("rank", query.rank())


def blocked(df: DataFrame, language: str = "english", block_docs: int = 512) -> DataFrame:
    """user_id, block, bookmark_id, words, n_title, n_text: each row's lexemes joined by blanks, title, body and tags after one another.

    A tenant has as many blocks as its rows need, `block_docs` in each on
    average; rows of one bookmark share a block.
    """
    # Only tenants of several blocks: a row for every `block_docs` rows at most.
    blocks = df.groupBy("user_id").agg(F.ceil(F.count("*") / block_docs).cast("int").alias("blocks")).where("blocks > 1").withColumnRenamed("user_id", "_tenant")
    parts = ["title_lexemes", "text_lexemes", "tag_lexemes"]
    docs = search_columns(df, language).select("user_id", "bookmark_id", F.array_join(F.concat(*parts), " ").alias("words"), F.size(parts[0]).alias("n_title"), F.size(parts[1]).alias("n_text"))
    docs = docs.join(F.broadcast(blocks), F.col("user_id").eqNullSafe(F.col("_tenant")), "left")
    block = F.pmod(F.xxhash64("bookmark_id"), F.coalesce("blocks", F.lit(1))).cast("int")
    # By the number of rows, so that what a task makes of its blocks, a multiple of their text, is sorted in memory.
    tasks = max(1, -(-df.count() // TASK_DOCS))
    return docs.select("user_id", block.alias("block"), "bookmark_id", "words", "n_title", "n_text").repartition(tasks, "user_id", "block")


@dataclass(frozen=True)
class Hits:
    """The words of a block's rows: of each one its row, lexeme (a place in `lexemes`), part (0 to 2) and place in the row."""

    lexemes: pa.Array
    row: np.ndarray
    lexeme: np.ndarray
    part: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, block: pa.Table) -> Hits:
        # A block may hold more than 2 GB of text.
        found = pc.split_pattern(block["words"].cast(pa.large_string()).combine_chunks(), " ")
        n = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        in_title = block["n_title"].to_numpy().astype(np.int64)
        before_tags = in_title + block["n_text"].to_numpy()
        part = (at >= in_title[row]).astype(np.int8) + (at >= before_tags[row])
        words = pc.list_flatten(found)
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        encoded = words.filter(pa.array(real)).dictionary_encode()
        return cls(encoded.dictionary, row[real], encoded.indices.to_numpy().astype(np.int64), part[real], at[real])


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where in sorted rows the keys change, 0 first; none of no rows."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    changed = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.concatenate([[0], np.flatnonzero(changed) + 1])


def _postings(block: pa.Table) -> pa.Table:
    hits, ids = Hits.of(block), block["bookmark_id"].combine_chunks().dictionary_encode("encode")
    doc = ids.indices.to_numpy().astype(np.int64)[hits.row]
    before = np.stack([np.zeros(block.num_rows, np.int64), block["n_title"].to_numpy(), block["n_title"].to_numpy() + block["n_text"].to_numpy()])
    position = hits.at - before[hits.part, hits.row]
    order = np.lexsort((position, doc, hits.part, hits.lexeme))
    lexeme, part, doc = hits.lexeme[order], hits.part[order], doc[order]
    first = runs(lexeme, part, doc)
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(position[order], pa.int32()))
    user = pa.repeat(block["user_id"][0], len(first))
    columns = [hits.lexemes.take(pa.array(lexeme[first])).cast(pa.string()), pa.array(list("ABC")).take(pa.array(part[first])), user, ids.dictionary.take(pa.array(doc[first])), positions]
    return pa.Table.from_arrays(columns, names=["lexeme", "weight", "user_id", "bookmark_id", "positions"])


def postings(df: DataFrame, language: str = "english") -> DataFrame:
    """lexeme, weight, user_id, bookmark_id, positions: what an index table holds.

    Written partitioned or bucketed by lexeme, a query then reads only its own
    terms.  Texts are shuffled once, as blocks; words are not.  Rows that share
    a tenant and an id are one bookmark.
    """
    schema = "lexeme string, weight string, user_id string, bookmark_id string, positions array<int>"
    return blocked(df, language).groupBy("user_id", "block").applyInArrow(_postings, schema)


def search_postings(index: DataFrame, terms: list[str], user_id: str) -> DataFrame:
    """bookmark_id and hits of the rows that hold all terms, from an index: the filters reach its scan."""
    found = index.where(F.col("lexeme").isin(terms) & (F.col("user_id") == user_id))
    per_row = found.groupBy("bookmark_id").agg(F.count_distinct("lexeme").alias("terms"), F.sum(F.size("positions")).alias("hits"))
    return per_row.where(F.col("terms") == len(set(terms))).select("bookmark_id", "hits")
