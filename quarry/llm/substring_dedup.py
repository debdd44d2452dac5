"""Substring dedup: windows of `width` words that an earlier document also has are cut out.

Rabin-Karp hashes of every window are counted across the corpus, and the
repeated windows of a document merge into maximal removal intervals.

1. A task hashes the windows of a block of documents and settles what the
   block alone can: of a window that several of its documents hold, all but
   the smallest doc_id lose it.  What remains, one document per window and
   block, is packed by hash bucket.  A window that millions of documents share
   therefore reaches its bucket once per block, not once per document.
2. A bucket finds the smallest doc_id of each hash over all blocks and sends
   back the places at which a larger document holds it.  Where there are more
   than STEP_BUCKETS of them, they are reached in two steps: rows of a range of
   buckets and a part of the blocks meet first, settle what that part alone
   can, and go on as one row per bucket; places return the same way.  So rows
   stay long at any size, and a window that all documents share reaches its
   bucket once per part.
3. The places of each block merge into intervals per document, which are
   joined to the texts.

Windows are told apart by 64 bits of one hash within the bucket that a second
hash chose.  Buckets are as many as BUCKET_BYTES of text need, so whatever the
size of the corpus a bucket holds a few million windows, fits a task, and takes
a given window for another one with a chance below 1e-12.  Only a window that
many documents share brings more: 9 bytes for each 4 MB of text that have it,
and in two steps some 20 bytes for each 32 GB.

Defined results: a null or empty text has no words; with fewer words than
`width` nothing goes; rows with an equal doc_id are never "smaller" than one
another, so repeated rows keep each other's text; a row without doc_id
neither loses words nor makes others lose any; other columns are ignored.  A
very long text is a block of its own, hashed in steps; its task needs some
twenty bytes for each of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal, small_batches
from .wordhash import Words, blocks

WIDTH = 13

#: Text whose windows one bucket gets.
BUCKET_BYTES = 8 << 20

#: Buckets that a block reaches in one step.
STEP_BUCKETS = 4096

#: Kinds of rows: windows to be judged, places settled within their block, the documents of a block.
JUDGE, SETTLED, TABLE = 0, 1, 2
_COLUMNS = "bucket int, block long, kind int, ids binary, sizes binary, places binary, hashes binary, buckets binary"
#: Rows of a bucket, each of a part of the blocks, and what they send back; `buckets` counts within a range.
_OF_PART = "bucket long, part int, block long, kind int, blocks binary, counts binary, ids binary, sizes binary, places binary, hashes binary"
_BACK = _OF_PART.removesuffix(", hashes binary")
_PLACES = "block long, kind int, ids binary, sizes binary, places binary"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], columns: str) -> pa.Table:
    fields = [x.split() for x in columns.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _cells(group: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(group.column(n).to_pylist() for n in names), strict=True)


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative numbers in the narrowest type that holds them, after a byte that names it."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in (1, 2, 4, 8) if top < 1 << (8 * k) or k == 8)
    return bytes([kind]) + values.astype(f"<u{kind}").tobytes()


def _wide(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, f"<u{cell[0]}", offset=1).astype(np.int64)


def _gaps(ascending: np.ndarray) -> bytes:
    return _narrow(np.diff(ascending, prepend=0))


def _places(cell: bytes) -> np.ndarray:
    return np.cumsum(_wide(cell))


def _pack_ids(ids: np.ndarray) -> bytes:
    """Any 64-bit numbers: zigzag of their differences, which is short where ids run on."""
    d = np.diff(ids, prepend=0)
    return _narrow(((d << 1) ^ (d >> 63)).view(np.uint64))


def _unpack_ids(cell: bytes) -> np.ndarray:
    z = np.frombuffer(cell, f"<u{cell[0]}", offset=1).astype(np.uint64)
    return np.cumsum((z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64))


def _groups(*sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values, or tuples of values, starts."""
    if not len(sorted_values[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in sorted_values], axis=0))))


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _later(docs: np.ndarray, *windows: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same window, by its hash or by several columns."""
    order = np.lexsort(windows)
    starts = _groups(*(x[order] for x in windows))
    first = np.empty(len(docs), np.int64)
    if len(docs):
        first[order] = np.repeat(np.minimum.reduceat(docs[order], starts), _lengths(starts, len(docs)))
    return docs > first


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    at = _groups(values)
    return zip(at.tolist(), [*at[1:].tolist(), len(values)][: len(at)], strict=True)


def _by_bucket(words: Words, keys: np.ndarray, width: int, n_buckets: int, ranges: int, block: int) -> Iterator[tuple]:
    window, at = words.windows(width, words.hashes())
    if not len(at):
        return
    # A second, independent rolling hash picks the bucket; buckets of one remainder are a range.
    bucket = (words.windows(width, words.hashes(salt=977), salt=977)[0] % np.uint64(n_buckets)).astype(np.int64)
    within, bucket = np.divmod(bucket, ranges)
    ids, owner = words.doc_ids, words.owner()[at]
    gone = _later(ids[owner], window)
    home = block % ranges
    yield (home, block, TABLE, _pack_ids(ids), _narrow(words.counts()), _pack_ids(keys), b"", b"")
    if gone.any():
        yield (home, block, SETTLED, b"", b"", _gaps(at[gone]), b"", b"")
    kept = np.flatnonzero(~gone)
    kept = kept[np.argsort(bucket[kept], kind="stable")]
    for a, b in _runs(bucket[kept]):
        part = kept[a:b]
        # Only the documents that the row names, and how many of its windows each has.
        named = _groups(owner[part])
        which = _narrow(within[part]) if n_buckets > ranges else b""
        yield (int(bucket[part[0]]), block, JUDGE, _pack_ids(ids[owner[part[named]]]), _narrow(_lengths(named, b - a)), _gaps(at[part]), window[part].astype("<u8").tobytes(), which)


def _scan(batches: Iterator[pa.RecordBatch], width: int, n_buckets: int, ranges: int) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        keys = batch.column(2).to_numpy(zero_copy_only=False)
        for a, b, words in blocks(batch):
            rows = list(_by_bucket(words, keys[a:b], width, n_buckets, ranges, block))
            block += 1
            if rows:
                yield from _table(rows, _COLUMNS).to_batches()


def _judge(group: pa.Table) -> pa.Table:
    """Of one bucket: the places that an earlier document makes go, a row per block; settled rows pass through."""
    rows, judged = [], []
    for block, kind, ids, sizes, places, hashes in _cells(group, "block", "kind", "ids", "sizes", "places", "hashes"):
        if kind == JUDGE:
            judged.append((block, _places(places), np.repeat(_unpack_ids(ids), _wide(sizes)), np.frombuffer(hashes, "<u8")))
        else:
            rows.append((block, kind, ids, sizes, places))
    if judged:
        later = _later(np.concatenate([x[2] for x in judged]), np.concatenate([x[3] for x in judged]))
        later = np.split(later, np.cumsum([len(x[1]) for x in judged])[:-1])
        rows += [(block, SETTLED, b"", b"", _gaps(places[gone])) for (block, places, _, _), gone in zip(judged, later, strict=True) if gone.any()]
    return _table(rows, _PLACES)


def _settled(block: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The places of each block, ascending."""
    order = np.lexsort((place, block))
    block, place = block[order], place[order]
    return ((int(block[a]), _gaps(place[a:b])) for a, b in _runs(block))


def _regroup(group: pa.Table, within: int) -> pa.Table:
    """Of a range of buckets and a part of the blocks: a row per bucket, without what the part settles alone."""
    rows, found = [], []
    wide, part = group.column("bucket")[0].as_py(), group.column("part")[0].as_py()
    for block, kind, ids, sizes, places, hashes, buckets in _cells(group, "block", "kind", "ids", "sizes", "places", "hashes", "buckets"):
        if kind == JUDGE:
            place = _places(places)
            found.append((_wide(buckets), np.full(len(place), block), place, np.repeat(_unpack_ids(ids), _wide(sizes)), np.frombuffer(hashes, "<u8")))
        else:
            rows.append((wide * within + block % within, part, block, kind, b"", b"", ids, sizes, places, b""))
    if found:
        bucket, block, place, doc, window = (np.concatenate(x) for x in zip(*found, strict=True))
        gone = _later(doc, window, bucket)
        rows += [(wide * within + b % within, part, b, SETTLED, b"", b"", b"", b"", cell, b"") for b, cell in _settled(block[gone], place[gone])]
        order = np.flatnonzero(~gone)
        order = order[np.lexsort((place[order], block[order], bucket[order]))]
        bucket, block, place, doc, window = bucket[order], block[order], place[order], doc[order], window[order]
        for a, b in _runs(bucket):
            of, named = _groups(block[a:b]), _groups(block[a:b], doc[a:b])
            cells = _pack_ids(block[a:b][of]), _narrow(_lengths(of, b - a)), _pack_ids(doc[a:b][named]), _narrow(_lengths(named, b - a)), _narrow(place[a:b]), window[a:b].astype("<u8").tobytes()
            rows.append((wide * within + int(bucket[a]), part, None, JUDGE, *cells))
    return _table(rows, _OF_PART)


def _judge_parts(group: pa.Table, within: int) -> pa.Table:
    """Of one bucket: as `_judge`, with rows of parts of the blocks, which go back to their range."""
    rows, judged = [], []
    for bucket, part, block, kind, of, counts, ids, sizes, places, hashes in _cells(group, *(x.split()[0] for x in _OF_PART.split(", "))):
        if kind == JUDGE:
            judged.append((bucket // within, part, np.repeat(_unpack_ids(of), _wide(counts)), _wide(places), np.repeat(_unpack_ids(ids), _wide(sizes)), np.frombuffer(hashes, "<u8")))
        else:
            rows.append((bucket // within, part, block, kind, of, counts, ids, sizes, places))
    if judged:
        later = _later(np.concatenate([x[4] for x in judged]), np.concatenate([x[5] for x in judged]))
        for (wide, part, block, place, _, _), gone in zip(judged, np.split(later, np.cumsum([len(x[3]) for x in judged])[:-1]), strict=True):
            if gone.any():
                of = _groups(block[gone])
                rows.append((wide, part, None, JUDGE, _pack_ids(block[gone][of]), _narrow(_lengths(of, gone.sum())), b"", b"", _narrow(place[gone])))
    return _table(rows, _BACK)


def _return(group: pa.Table) -> pa.Table:
    """Of a range of buckets and a part of the blocks: the places that go, a row per block."""
    rows, found = [], []
    for block, kind, of, counts, ids, sizes, places in _cells(group, "block", "kind", "blocks", "counts", "ids", "sizes", "places"):
        if kind == JUDGE:
            found.append((np.repeat(_unpack_ids(of), _wide(counts)), _wide(places)))
        else:
            rows.append((block, kind, ids, sizes, places))
    if found:
        rows += [(block, SETTLED, b"", b"", cell) for block, cell in _settled(*(np.concatenate(x) for x in zip(*found, strict=True)))]
    return _table(rows, _PLACES)


def _merge(group: pa.Table, width: int) -> pa.Table:
    """Of one block: the places of each document, merged into maximal intervals of words."""
    found, table = [], None
    for kind, ids, sizes, places in _cells(group, "kind", "ids", "sizes", "places"):
        if kind == TABLE:
            table = _unpack_ids(ids), _wide(sizes), _unpack_ids(places)
        else:
            found.append(_places(places))
    ids, sizes, keys = table
    at = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, at, "right")
    # A window ends inside its document, so an interval never reaches the next one; adjacent intervals of two documents stay apart.
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] > at[:-1] + width) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    own = owner[first]
    begin = at[first] - (ends - sizes)[own]
    end = at[last] + width - (ends - sizes)[own]
    of = _groups(own)
    offsets = pa.array(np.append(of, len(first)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (begin, end)]
    return pa.table([pa.array(ids[own[of]]), pa.array(keys[own[of]]), *lists], names=["doc_id", "text_key", "removed_from", "removed_to"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            n_words, n_removed, kept = [], [], []
            for text, begin, end in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                gone = 0
                for a, b in reversed(list(zip(begin or (), end or (), strict=True))):
                    gone += b - a
                    del words[a:b]
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), part.column(2), part.column(3), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "removed_from", "removed_to", "kept"])


def substring_dedup(docs: DataFrame, width: int = WIDTH, buckets: int | None = None, step: int = STEP_BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed_from, removed_to (word positions, end excluded), kept (text).

    `buckets` defaults to what the size of the texts needs; more than `step` are reached in two steps.
    """
    n = buckets or 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text"))
    within = -(-n // step)  # buckets of a range, and parts of the blocks
    ranges, n = (step, step * within) if within > 1 else (n, n)
    packed = docs.where("doc_id is not null").mapInArrow(frugal(lambda it: _scan(it, width, n, ranges)), _COLUMNS)
    if within == 1:
        answers = packed.groupBy("bucket").applyInArrow(_judge, _PLACES)
    else:
        parts = packed.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(within)).cast("int"))
        judged = parts.groupBy("bucket", "part").applyInArrow(lambda t: _regroup(t, within), _OF_PART).groupBy("bucket").applyInArrow(lambda t: _judge_parts(t, within), _BACK)
        answers = judged.groupBy("bucket", "part").applyInArrow(_return, _PLACES)
    spans = answers.groupBy("block").applyInArrow(lambda t: _merge(t, width), "doc_id long, text_key long, removed_from array<int>, removed_to array<int>")
    spans = spans.groupBy("doc_id", "text_key").agg(F.any_value("removed_from").alias("removed_from"), F.any_value("removed_to").alias("removed_to"))
    joined = docs.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "removed_from", "removed_to")
    return joined.mapInArrow(frugal(_keep), "doc_id long, n_words long, n_removed long, removed_from array<int>, removed_to array<int>, kept string")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, md5(list_aggregate(ws[i : i + 12], 'string_agg', ' ')) AS h FROM starts),
m AS (SELECT h, min(doc_id) AS first_doc FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k.j AS p FROM g JOIN m USING (h), (SELECT unnest(generate_series(0, 12)) AS j) k WHERE g.doc_id > m.first_doc),
r AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
pos AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM w WHERE len(ws) > 0),
kept AS (SELECT pos.doc_id, string_agg(ws[pos.p], ' ' ORDER BY pos.p) AS k FROM pos ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
