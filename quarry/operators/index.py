"""A stored full-text index and queries that read nothing else.

A row of the index is a lexeme in one block of a tenant's documents: for each
document the lexeme's places and how many of them are in title and body, and
bounds over the block (most hits, heaviest part, best rank by occurrence).
Documents are numbered within their block, so rows of equal ids stay apart.
The empty lexeme has the documents themselves with their lengths.  Written bucketed and sorted by
lexeme, a query reads the rows of its own words.  All that it decides (and, or,
not, phrases, rank) comes from those rows, a group of at most as many rows as
the query has words for each document.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fts
from . import rank as R
from .fts import Clause, WebQuery

#: Documents of a block, on average.
BLOCK_DOCS = 512
_BLOCK = ("user_id", "block")


def _back(steps: int):
    return lambda place: place - steps


def weights_of(n_title: Column, n_text: Column, n: Column) -> Column:
    """Weights of n places, the first ones in the title, the next ones in the body, the rest in tags."""
    counts = zip("ABC", (n_title, n_text, n - n_title - n_text), strict=True)
    return F.concat(*[F.array_repeat(F.lit(R.PART_WEIGHTS[part]), count.cast("int")) for part, count in counts])


_SCHEMA = """lexeme string, user_id string, block int, most_hits int, best_weight double, best_rank double,
docs array<int>, ids array<string>, ends array<int>, places array<int>, n_title array<int>, n_text array<int>"""


def _lists(firsts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), values)


def _index_rows(block: pa.Table) -> pa.Table:
    """The rows of the index for one block of a tenant's documents."""
    hits, ids, n_docs = fts.Hits.of(block), block["bookmark_id"].combine_chunks(), block.num_rows
    order = np.lexsort((hits.at, hits.row, hits.lexeme))
    lexeme, row, at, part = (x[order] for x in (hits.lexeme, hits.row, hits.at, hits.part))
    first = fts.runs(lexeme, row)
    n = np.diff(np.append(first, len(order)))
    n_title, n_text = (np.add.reduceat(part == p, first, dtype=np.int32) if len(first) else np.zeros(0, np.int32) for p in (0, 1))
    doc, rows = row[first], fts.runs(lexeme[first])
    squares = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1.0, n.max(initial=0) + 1) ** 2)])
    a, b = n_title, n_title + n_text
    weight = [R.PART_WEIGHTS[x] for x in "ABC"]
    ranks = (weight[0] * squares[a] + weight[1] * (squares[b] - squares[a]) + weight[2] * (squares[n] - squares[b])) / R.SQUARES
    heaviest = np.array(weight)[part[first]]
    best = [np.maximum.reduceat(x, rows) if len(rows) else x for x in (n, heaviest, ranks)]
    # Behind the words' rows stands that of the documents themselves.
    sizes = np.stack([np.bincount(row, minlength=n_docs), np.bincount(doc, minlength=n_docs)], axis=1).ravel()
    whole = np.zeros(n_docs, np.int32)
    of_row = np.concatenate([rows, [len(first), len(first) + n_docs]])
    doc_of = np.concatenate([doc, np.arange(n_docs)])
    # The end of each document's places among those of its row.
    base = first[rows] if len(rows) else np.zeros(0, np.int64)
    ends = np.concatenate([first + n - np.repeat(base, np.diff(np.append(rows, len(first)))), 2 * np.arange(1, n_docs + 1)])
    columns = [
        pa.concat_arrays([hits.lexemes.take(pa.array(lexeme[first][rows])).cast(pa.string()), pa.array([""])]),
        pa.repeat(block["user_id"][0], len(rows) + 1),
        pa.repeat(block["block"][0], len(rows) + 1),
        pa.array(np.append(best[0], 2), pa.int32()),
        pa.concat_arrays([pa.array(best[1], pa.float64()), pa.nulls(1, pa.float64())]),
        pa.array(np.append(best[2], 0.0), pa.float64()),
        _lists(of_row, pa.array(doc_of, pa.int32())),
        _lists(of_row, ids.take(pa.array(doc_of))),
        _lists(of_row, pa.array(ends, pa.int32())),
        _lists(np.concatenate([base, [len(order), len(order) + 2 * n_docs]]), pa.array(np.concatenate([at, sizes]), pa.int32())),
        _lists(of_row, pa.array(np.concatenate([n_title, whole]), pa.int32())),
        _lists(of_row, pa.array(np.concatenate([n_text, whole]), pa.int32())),
    ]
    return pa.Table.from_arrays(columns, names=["lexeme", *_BLOCK, "most_hits", "best_weight", "best_rank", "docs", "ids", "ends", "places", "n_title", "n_text"])


def build(df: DataFrame, language: str = "english", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The index of bookmarks: lexeme, user_id, block, most_hits, best_weight, best_rank, and per document docs, ids, ends, n_title, n_text.

    Places run through title, body and tags; those of a document end in
    `places` where `ends` says.  A tenant has as many blocks as its documents
    need, so no row grows with the tenant.  Texts are shuffled once, to their
    blocks; words are not.
    """
    return fts.blocked(df, language, block_docs).groupBy(*_BLOCK).applyInArrow(_index_rows, _SCHEMA)


def write(index: DataFrame, table: str, buckets: int) -> None:
    """Bucketed and sorted by lexeme, then tenant: a query reads the buckets and row groups of its words."""
    index.write.mode("overwrite").bucketBy(buckets, "lexeme").sortBy("lexeme", "user_id").saveAsTable(table)


def _words(clause: Clause, language: str) -> list[tuple[int, str]]:
    """Wanted lexemes of a clause with their distance from its first word; stop words have no entry."""
    return [(i, x) for i, x in enumerate(clause.lexemes(language)) if x]


def _holds(clause: Clause, language: str) -> Column:
    """Whether the document of a row has the clause's words, one after the other; `places` maps lexemes to places."""
    words = _words(clause, language)
    starts = [F.transform(F.coalesce(F.try_element_at("places", F.lit(x)), F.array().cast("array<int>")), _back(i)) for i, x in words]
    return F.size(reduce(F.array_intersect, starts)) > 0 if len(starts) > 1 else F.map_contains_key("places", words[0][1])


def _conjunction(group: tuple[Clause, ...], language: str) -> Column:
    return reduce(and_, [~_holds(c, language) if c.negated else _holds(c, language) for c in group])


def _rows(index: DataFrame, query: WebQuery, user_id: str | None, always: bool) -> DataFrame:
    """The rows that the query reads; those of the documents themselves only where it asks for what is not there, or for lengths."""
    wanted = query.lexemes()
    if always or any(all(c.negated for c in g) for g in query.groups):
        wanted = ["", *wanted]
    found = index.where(F.col("lexeme").isin(wanted))
    return found if user_id is None else found.where(F.col("user_id") == user_id)


def _entries() -> Column:
    """What a row holds of each of its documents."""

    def entry(doc: Column, i: Column) -> Column:
        begin = F.when(i > 0, F.get("ends", i - 1)).otherwise(F.lit(0))
        places = F.slice("places", begin + 1, F.get("ends", i) - begin)
        return F.struct(doc.alias("doc"), F.get("ids", i).alias("bookmark_id"), places.alias("places"), F.get("n_title", i).alias("n_title"), F.get("n_text", i).alias("n_text"))

    return F.transform("docs", entry)


def _ranked(rows: DataFrame, query: WebQuery, flags: int) -> DataFrame:
    """bookmark_id and rank of the matching documents of some rows."""
    docs = rows.select("lexeme", *_BLOCK, F.inline(_entries()))
    entry = F.struct("lexeme", F.struct("places", "n_title", "n_text"))
    docs = docs.groupBy(*_BLOCK, "doc").agg(F.any_value("bookmark_id").alias("bookmark_id"), F.map_from_entries(F.collect_list(entry)).alias("hits"))
    docs = docs.withColumn("places", F.transform_values("hits", lambda _, v: v["places"]))
    docs = docs.where(reduce(or_, [_conjunction(g, query.language) for g in query.groups]))
    terms = query.operands()
    of = [F.try_element_at("hits", F.lit(t)) for t in terms]
    weights = [weights_of(x["n_title"], x["n_text"], F.size(x["places"])) for x in of]
    if query.by_proximity():
        none = F.array().cast("array<int>"), F.array().cast("array<double>")
        score = R.proximity(F.array(*[F.struct(F.coalesce(x["places"], none[0]).alias("places"), F.coalesce(w, none[1]).alias("weights")) for x, w in zip(of, weights, strict=True)]))
    else:
        score = sum((R.occurrence(w) for w in weights), F.lit(0.0)) / max(1, len(terms))
    if flags:
        size = F.try_element_at("hits", F.lit(""))["places"]
        score = R.normalized(score, F.get(size, F.lit(0)), F.get(size, F.lit(1)), flags)
    return docs.select("bookmark_id", score.alias("rank"))


def search(index: DataFrame, query: WebQuery, user_id: str | None, flags: int = 0) -> DataFrame:
    """bookmark_id and rank of every row of a tenant, or of all, that matches."""
    if not query.groups:
        return index.select(F.lit("").alias("bookmark_id"), F.lit(0.0).alias("rank")).limit(0)
    return _ranked(_rows(index, query, user_id, bool(flags)), query, flags)


def _bounds(rows: DataFrame, query: WebQuery) -> DataFrame:
    """block and bound: what no document of the block can outrank; blocks that lack a word that every match needs are out."""
    terms = query.operands()
    if not query.by_proximity():
        return rows.groupBy(*_BLOCK).agg((F.sum(F.when(F.col("lexeme").isin(terms), F.col("best_rank")).otherwise(F.lit(0.0))) / max(1, len(terms))).alias("bound"))
    needed = sorted({x for c in query.groups[0] if not c.negated for _, x in _words(c, query.language)})
    per = rows.where(F.col("lexeme").isin(needed)).groupBy(*_BLOCK).agg(F.collect_list(F.struct("lexeme", "most_hits", "best_weight")).alias("t")).where(F.size("t") == len(needed))
    # Of every two terms as many pairs as the block's fullest documents could have, all of them side by side.
    closest = float(R.nearness(R.np.array([1]))[0])
    pairs = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b["lexeme"] < a["lexeme"]), lambda b: F.struct((a["most_hits"].cast("double") * b["most_hits"]).alias("n"), F.sqrt(a["best_weight"] * b["best_weight"] * closest).alias("w")))))
    none = F.aggregate(pairs, F.lit(1.0), lambda s, p: s * F.pow(1 - p["w"], p["n"]))
    return per.select(*_BLOCK, (1 - none + 1e-9).alias("bound"))


def top(index: DataFrame, query: WebQuery, user_id: str | None, k: int, first: int = 4) -> DataFrame:
    """The k best matches of a tenant, best first, ties by bookmark_id, without opening blocks that cannot hold one.

    The `first` blocks with the highest bounds are searched; the kth rank found
    there rules out every block whose bound is lower, and the rest is searched
    at once.  What is held on the driver is one number.
    """
    if not query.groups:
        return search(index, query, user_id)
    rows = _rows(index, query, user_id, False)
    bounds = _bounds(rows, query)
    best = bounds.orderBy(F.desc("bound"), *_BLOCK).limit(first)
    order = F.desc("rank"), F.col("bookmark_id")
    tried = _ranked(rows.join(F.broadcast(best.select(*_BLOCK)), [*_BLOCK], "left_semi"), query, 0)  # `first` rows
    kth = tried.select("rank", "bookmark_id").orderBy(*order).limit(k).agg(F.count("*").alias("n"), F.min("rank").alias("rank")).first()
    # Ranks and bounds are sums of doubles in different orders.
    allowed = bounds.where(F.col("bound") >= kth["rank"] - 1e-9) if kth["n"] == k else bounds
    return _ranked(rows.join(allowed.select(*_BLOCK), [*_BLOCK], "left_semi"), query, 0).orderBy(*order).limit(k)


def page(index: DataFrame, query: WebQuery, user_id: str, bookmarks: DataFrame, limit: int) -> DataFrame:
    """The columns of the best matches: only their rows are joined."""
    found = top(index, query, user_id, limit)
    order = Window.orderBy(F.desc("rank"), "bookmark_id")  # `limit` rows
    found = found.withColumn("place", F.row_number().over(order))
    return bookmarks.where(F.col("user_id") == user_id).join(F.broadcast(found), "bookmark_id").orderBy("place")
