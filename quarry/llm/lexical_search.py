"""Ranked lexical search, term at a time with a limited set of accumulators.

1. Tasks index the documents block by block: of every term that some item may
   ask for, the block's documents and frequencies.  A bit map of the items'
   terms, of a fixed size at any number of items, keeps all other terms out.
   The index is cut; all that follows reads it instead of the texts.
2. The numbers of documents and terms, and every wanted term's number of
   documents, are sums over the index, from which the items' weights follow.
3. Groups of blocks meet blocks of items.  For an item its terms are taken
   rarest first.  A term adds to the accumulators of its documents, and makes
   new ones only while a document met now for the first time could still reach
   the kth partial score: once the remaining terms' largest contributions sum
   to less, no accumulator is made any more, but those that exist are updated
   exactly to the end.  The best k of each group merge in a window, of which
   only k rows an item leave a task.

Documents are dealt out, not terms, so a term that every document holds is
spread over all groups.

Defined results: a term is a maximal run of digits, Latin letters and
characters beyond ASCII, A-Z lower-cased; a null or empty text has none and is
no document; rows that repeat a doc_id are documents of their own; a row
without doc_id counts in all statistics but is no result; items that repeat
both id and text count once, different texts under one id are ranked each for
itself; an item without terms, or whose terms nobody has, has no rows; fewer
than k come back where fewer score above 0; ties go to the smaller doc_id;
other columns are ignored.  Terms of a block are told apart by 64-bit hashes;
all else compares the terms themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, frugal, small_batches
from .wordhash import blocks, split_terms

K = 20
#: Bits of the map of wanted terms: half a megabyte, whatever the number of items.
MAP_BITS = 1 << 22
#: Text whose index one task holds, and items that it ranks at a time.
GROUP_BYTES, ITEM_BLOCK = 32 << 20, 4096

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_INDEX = "block long, n_bytes long, n_docs long, n_terms long, ids binary, lengths binary, terms array<string>, dfs array<int>, docs binary, tfs binary"
_NO_ID = -(2**63)


def terms_column(text: str) -> Column:
    """Array of the terms of a text; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of terms, one to a row, in the bit map."""
    for batch in batches:
        for _, _, words in blocks(batch, "term", "id", split_terms):
            yield pa.RecordBatch.from_arrays([pa.array((words.hashes(True) & np.uint64(MAP_BITS - 1)).astype(np.int64))], names=["place"])


def _wanted(terms: DataFrame) -> np.ndarray:
    """The bit map of `terms` (term): at most MAP_BITS / 64 rows come to the driver."""
    places = terms.select("term", F.lit(0).cast("long").alias("id")).mapInArrow(_places, "place long")
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    found = words.toArrow()
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return np.unpackbits(bits.astype("<i8").view(np.uint8), bitorder="little").astype(bool)


def _index(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    asked = wanted.value
    for batch in batches:
        for first, end, words in blocks(batch, cut=split_terms):
            counts = words.counts()
            hashes = words.hashes(True)
            at = np.flatnonzero(asked[(hashes & np.uint64(MAP_BITS - 1)).astype(np.int64)])
            owner = words.owner()[at]
            at_order = np.argsort(hashes[at], kind="stable")  # documents of a term stay in order
            at, owner, key = at[at_order], owner[at_order], hashes[at[at_order]]
            new_term = np.ones(len(at), bool)
            new_term[1:] = key[1:] != key[:-1]
            new = new_term.copy()
            new[1:] |= owner[1:] != owner[:-1]
            begins = np.flatnonzero(new)
            tf = np.diff(np.append(begins, len(at)))
            term_at = np.flatnonzero(new_term[begins])  # first posting of each term
            raw = words.data.tobytes()
            terms = [raw[a:b].lower().decode() for a, b in zip(words.starts[at[begins[term_at]]].tolist(), words.ends[at[begins[term_at]]].tolist(), strict=True)]
            dfs = np.diff(np.append(term_at, len(begins)))
            ids = words.doc_ids.astype("<i8")
            # Any number that deals blocks out evenly, the same for each try of a task.
            block = int(hashes[:1024].sum(dtype=np.uint64) ^ np.uint64(ids.sum() & 0x7FFFFFFFFFFFFFFF)) & 0x7FFFFFFFFFFFFFFF
            row = [block, len(raw), int((counts > 0).sum()), int(counts.sum()), ids.tobytes(), counts.astype("<i8").tobytes(), terms, dfs.tolist(), owner[begins].astype("<i4").tobytes(), tf.astype("<i4").tobytes()]
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.string()), pa.list_(pa.int32())] + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])


class Postings:
    """The postings of a group of blocks, by term, with their impacts (what a hit counts, before the term's weight)."""

    def __init__(self, rows: pa.Table, n_docs: int, n_terms: int) -> None:
        def joined(name: str, kind: str) -> list[np.ndarray]:
            return [np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]

        ids, docs = joined("ids", "<i8"), joined("docs", "<i4")
        base = np.cumsum([0, *map(len, ids)])
        self.ids = np.concatenate(ids)
        lengths = np.concatenate(joined("lengths", "<i8"))
        m = 75 + (25 * lengths * n_docs) // n_terms
        doc = np.concatenate([d.astype(np.int64) + b for d, b in zip(docs, base[:-1], strict=True)])
        tf = np.concatenate(joined("tfs", "<i4")).astype(np.int64)
        names = pa.concat_arrays([x.flatten() for x in rows.column("terms").chunks]).dictionary_encode()
        dfs = pa.concat_arrays([x.flatten() for x in rows.column("dfs").chunks]).to_numpy()
        code = np.repeat(names.indices.to_numpy(), dfs)
        # A document without id is no result.
        named = np.flatnonzero(self.ids[doc] != _NO_ID)
        order = named[np.argsort(code[named], kind="stable")]
        self.docs, code = doc[order], code[order]
        self.impacts = (1_000_000_000 * tf[order]) // (1000 * tf[order] + 12 * m[self.docs])
        self.starts = np.searchsorted(code, np.arange(len(names.dictionary) + 1))
        self.place = {t: i for i, t in enumerate(names.dictionary.to_pylist()) if self.starts[i] < self.starts[i + 1]}

    def of(self, term: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Documents and impacts of a term."""
        i = self.place.get(term)
        return None if i is None else (self.docs[self.starts[i] : self.starts[i + 1]], self.impacts[self.starts[i] : self.starts[i + 1]])


def best_of(postings: Postings, terms: list[str], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """doc_id and score of the best k for terms that come rarest first, and the number of accumulators made."""
    found = [(w, *hit) for t, w in zip(terms, weights, strict=True) if (hit := postings.of(t)) is not None]
    # What the terms from each on can add to a document at most.
    rest = np.append(np.cumsum([w * int(impacts.max()) for w, _, impacts in found][::-1])[::-1], 0).astype(np.int64)
    scores, made, making = np.zeros(len(postings.ids), np.int64), np.zeros(len(postings.ids), bool), True
    for i, (w, docs, impacts) in enumerate(found):
        # The kth partial score is at most the highest.  A new document that could only tie might still win by its id.
        if making and i and rest[i] < scores.max():
            live = scores[made]
            making = len(live) < k or rest[i] >= np.partition(live, len(live) - k)[len(live) - k]
        if making:
            made[docs] = True
            scores[docs] += w * impacts
        else:
            old = made[docs]
            scores[docs[old]] += w * impacts[old]
    at = np.flatnonzero(scores > 0)
    if len(at) > 4 * k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    at = at[np.lexsort((postings.ids[at], -scores[at]))[:k]]
    return postings.ids[at], scores[at], int(made.sum())


def _rank(index: pa.Table, items: pa.Table, n_docs: int, n_terms: int, k: int) -> pa.Table:
    of, ids, scores = [], [], []
    if index.num_rows and items.num_rows:
        postings = Postings(index, n_docs, n_terms)
        for i, terms in enumerate(items.column("terms").to_pylist()):
            best, score, _ = best_of(postings, [t["term"] for t in terms], [t["weight"] for t in terms], k)
            of += [i] * len(best)
            ids.append(best)
            scores.append(score)
    flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (ids, scores)]
    return pa.table([*[items.column(c).take(pa.array(of, pa.int64())) for c in ("item_id", "key")], *flat], names=["item_id", "key", "doc_id", "score"])


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """items: item_id, text.  item_id, rank (from 1), doc_id, score: the k best documents of each item."""
    asked = items.select("item_id", "text").distinct().withColumn("key", F.xxhash64("text"))
    asked = asked.select("item_id", "key", F.explode(terms_column("text")).alias("term")).groupBy("item_id", "key", "term").agg(F.count("*").alias("times"))
    wanted = docs.sparkSession.sparkContext.broadcast(_wanted(asked.select("term").distinct()))  # MAP_BITS bytes
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = cut(texts.mapInArrow(frugal(lambda it: _index(it, wanted)), _INDEX))
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("terms"), F.sum("n_bytes").alias("bytes")).first()
    n_docs, n_terms = size["n"] or 0, size["terms"] or 0

    held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    weighed = asked.join(held, "term").withColumn("weight", F.col("times") * F.floor(1000 * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))))
    # Rarest first.
    ready = weighed.where("weight > 0").groupBy("item_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "term", "weight"))), lambda t: t.dropFields("df")).alias("terms"))
    ready = cut(ready)
    n_groups, n_items = 1 + (size["bytes"] or 0) // group_bytes, max(1, -(-ready.count() // ITEM_BLOCK))
    groups = index.where("n_docs > 0").withColumn("c", F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_items - 1))))
    ready = ready.withColumn("q", F.pmod(F.xxhash64("item_id", "key"), F.lit(n_items)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    kind = ready.schema["item_id"].dataType.simpleString()
    found = groups.groupBy("c", "q").cogroup(ready.groupBy("c", "q")).applyInArrow(lambda a, b: _rank(a, b, n_docs, n_terms, k), f"item_id {kind}, key long, doc_id long, score long")
    order = Window.partitionBy("item_id", "key").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS ws FROM documents),
d AS (SELECT rid, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM t WHERE len(ws) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM d),
p AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) GROUP BY rid, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM i) GROUP BY item_id, text, term),
w AS (SELECT item_id, text, term, times * CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM q JOIN f USING (term), s),
g AS (SELECT item_id, text, d.rid, any_value(d.doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * d.n * nd) // nt)))) AS BIGINT) AS score FROM w JOIN p USING (term) JOIN d ON d.rid = p.rid, s WHERE d.doc_id IS NOT NULL GROUP BY item_id, text, d.rid),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM g WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
