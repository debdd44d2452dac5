"""Suffix-array dedup: every string of `width` bytes that starts at two places of the corpus goes, at all its places.

Suffixes are ordered by their first `width` bytes, bucket by bucket, with a
difference cover of period v: residues such that for any two places some
offset below v takes both onto the cover.

1. Documents are dealt into blocks by a hash.  Each block names its cover
   samples, one place in seven for v = 57: strings of width - v + 1 bytes, by
   their Rabin-Karp hash.  A bucket of hashes finds the samples that occur
   twice.  A suffix that is to go begins less than v before such a sample, as
   the places of both copies have a common one, so all others are out.
2. What remains, stretches of text, is dealt into suffix buckets: the bucket of
   a suffix is the least hash of the 16-byte strings in its first `width`
   bytes, and neighbours that share it travel as one string.  Equal strings
   collapse, in the block and then by an aggregation with map-side combine.
3. A bucket sorts its suffixes, one range of first words at a time.  First the
   ranks of the bucket's cover samples are made, by sorting strings of v bytes
   and then doubling with period v.  Suffixes are told apart by their first
   v - 1 and their last bytes, a word of eight at a time, and those that still
   tie by the ranks: two of them are equal if and only if some offset takes
   both onto samples of one rank.  This compares bytes, not hashes.
4. The places that go return to their blocks and merge into spans.  Only
   documents that may have spans are joined to them.

Memory is bounded: blocks and buckets follow from the size of the texts.  A
bucket of more than `hot` bytes, as of one 16-byte string between very many
different neighbours, is not sorted in one task: its suffixes are told apart
by 128 bits of fingerprints, which Spark counts as rows.  Buckets of samples are
reached in two steps where there are many, so rows stay long at any size.

Defined results: a null or empty text has no bytes; texts shorter than `width`
stay; matches never cross documents, overlapping ones count; rows that repeat
a doc_id, or a whole row, are documents of their own and cut each other; a row
without doc_id takes part like any other; an empty table gives an empty
result; other columns are ignored.  A very long text is a block of its own,
which takes about a hundred bytes for each of it at most.  Hashes of 32 bits
beside the bucket only choose what is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stored, cut, frugal, marked
from .wordhash import _byte_values, _rolled, mix, text_buffers

WIDTH = 400
#: Perfect difference sets, by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Text of a block; text whose samples one bucket gets; text whose suffixes one bucket could get.
BLOCK_BYTES, SAMPLE_BUCKET, SUFFIX_BUCKET = 4 << 20, 8 << 20, 4 << 20
#: Different text that one task sorts; suffixes that it sorts at a time; bytes of the strings whose least hash names a bucket; suffixes of one string at most.
HOT, SORTED, GRAM, LONGEST = 96 << 20, 1 << 20, 16, 1 << 16
#: Bits of a sample beside its bucket, and bits of a bucket that are reached in one step.
BITS, STEP_BITS = 32, 12
#: Samples that are sorted into their buckets at a time.
REGROUPED = 4 << 20

_SAMPLES = "bucket long, blocks binary, counts binary, hashes binary"
_STRINGS = "block long, sid int, bucket long, n int, text binary, doc_ids binary, keys binary, ends binary, starts binary, sids binary"
_NO_ID = -(2**63)


def cover(width: int) -> tuple[int, np.ndarray]:
    """Period and residues for strings of `width` bytes."""
    if width < 16:
        raise ValueError("width must be at least 16")
    period = max(p for p in COVERS if 7 * p <= width)
    return period, np.array(COVERS[period])


class Block:
    """The texts of a block one after the other, in an order that depends on them alone."""

    def __init__(self, table: pa.Table) -> None:
        table = table.select(["doc_id", "text", "text_key"]).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        text = table.column("text")
        text = text.chunk(0) if text.num_chunks else pa.array([], pa.string())
        self.data, self.offsets = text_buffers(text)
        self.data, self.offsets = self.data[self.offsets[0] : self.offsets[-1]], self.offsets - self.offsets[0]
        self.doc_ids = table.column("doc_id").fill_null(_NO_ID).to_numpy().astype(np.int64)
        self.keys = table.column("text_key").to_numpy().astype(np.int64)

    def samples(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the cover samples, ascending; a document's places count from its start."""
        period, residues = cover(width)
        length = width - period + 1
        room = np.diff(self.offsets) - length + 1  # places at which a sample fits
        room[np.diff(self.offsets) < width] = 0
        top = int(room.max(initial=0))
        each = (np.arange(-(-top // period))[:, None] * period + residues).ravel()
        parts = [each[: np.searchsorted(each, n)] + at for at, n in zip(self.offsets[:-1].tolist(), room.tolist(), strict=True) if n > 0]
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        values = _byte_values(False, 5)
        return at, mix(_rolled(lambda a, b: values[self.data[a:b]], at, at + length, 0))

    def strings(self, width: int, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of suffixes and hash of the 16-byte string of each run of neighbours that begin less than a period before a tied sample."""
        period, _ = cover(width)
        near = np.zeros(len(self.data) + 1, np.int32)
        first = self.offsets[np.searchsorted(self.offsets, tied, "right") - 1]
        np.add.at(near, np.maximum(tied - period + 1, first), 1)
        np.add.at(near, tied + 1, -1)
        near = np.cumsum(near[:-1]) > 0
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            near[max(a, b - width + 1) : b] = False  # no room for the whole string
        at = np.flatnonzero(near)
        if not len(at):
            return at, at, at.astype(np.uint64)
        # The 16-byte strings of all stretches, and the least of those of each suffix.
        span = width - GRAM + 1
        inside = np.zeros(len(self.data) + 1, np.int32)
        heads = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        tails = np.append(heads[1:], len(at)) - 1
        np.add.at(inside, at[heads], 1)
        np.add.at(inside, at[tails] + span, -1)
        grams = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        values = _byte_values(False, 9)
        hashes = mix(_rolled(lambda a, b: values[self.data[a:b]], grams, grams + GRAM, 1))
        least = _sliding_min(hashes, span)[np.searchsorted(grams, at)]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(at)))
        if counts.max() > LONGEST:  # as of one character again and again
            pieces = -(-counts // LONGEST)
            of = np.repeat(np.arange(len(heads)), pieces)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            heads, counts = heads[of] + nth * LONGEST, np.minimum(LONGEST, counts[of] - nth * LONGEST)
        return at[heads], counts, least[heads]


def _sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """The least of the `span` values from each place on; places too near the end hold the least of what is there."""
    padded = np.full(-(-(len(values) + span) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = values
    parts = padded.reshape(-1, span)
    before = np.minimum.accumulate(parts, axis=1).ravel()
    after = np.minimum.accumulate(parts[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: len(values)], before[span - 1 : span - 1 + len(values)])


def _packed(hashes: np.ndarray, n_bytes: int) -> bytes:
    """The upper bytes of each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - n_bytes :].tobytes()


def _unpacked(cell: bytes, n_bytes: int) -> np.ndarray:
    out = np.zeros((len(cell) // n_bytes, 8), np.uint8)
    out[:, 8 - n_bytes :] = np.frombuffer(cell, np.uint8).reshape(-1, n_bytes)
    return out.view("<u8").ravel()


def _sample_rows(hashes: np.ndarray, blocks: np.ndarray, bits: int, n_bytes: int) -> pa.Table:
    """A row per bucket; hashes of one block stand together in it."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    order = np.lexsort((blocks, bucket))
    hashes, blocks, bucket = hashes[order], blocks[order], bucket[order]
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    cells = []
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)][: len(heads)], strict=True):
        of = np.flatnonzero(np.concatenate(([True], blocks[a + 1 : b] != blocks[a : b - 1])))
        cells.append((int(bucket[a]), blocks[a:b][of].astype("<i8").tobytes(), np.diff(np.append(of, b - a)).astype("<i4").tobytes(), _packed(hashes[a:b], n_bytes)))
    return pa.table([pa.array([c[i] for c in cells], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "blocks", "counts", "hashes"])


def _expanded(table: pa.Table | pa.RecordBatch, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and block of every sample of some rows."""
    hashes, blocks = [], []
    for b, c, h in zip(*(table.column(n).to_pylist() for n in ("blocks", "counts", "hashes")), strict=True):
        hashes.append(_unpacked(h, n_bytes))
        blocks.append(np.repeat(np.frombuffer(b, "<i8"), np.frombuffer(c, "<i4")))
    return (np.concatenate(hashes), np.concatenate(blocks)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _regroup(batches: Iterator[pa.RecordBatch], bits: int, n_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of wide buckets become rows of narrow ones, of many blocks each."""
    held, n = [], 0
    for batch in batches:
        for at in range(batch.num_rows):
            held.append(_expanded(batch.slice(at, 1), n_bytes))
            n += len(held[-1][0])
            if n >= REGROUPED:
                yield from _sample_rows(*map(np.concatenate, zip(*held, strict=True)), bits, n_bytes).to_batches()
                held, n = [], 0
    if held:
        yield from _sample_rows(*map(np.concatenate, zip(*held, strict=True)), bits, n_bytes).to_batches()


def _tied(group: pa.Table, n_bytes: int) -> pa.Table:
    """Of one bucket: the samples that several blocks hold, a row per block."""
    hashes, blocks = _expanded(group, n_bytes)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hashes, blocks = hashes[twice], blocks[twice]
    order = np.argsort(blocks, kind="stable")
    hashes, blocks = hashes[order], blocks[order]
    heads = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1]))) if len(blocks) else np.zeros(0, np.int64)
    cells = [_packed(h, n_bytes) for h in np.split(hashes, heads[1:])] if len(heads) else []
    return pa.table([pa.array(blocks[heads]), pa.array(cells, pa.binary())], names=["block", "hashes"])


def _stretches(texts: pa.Table, tied: pa.Table, width: int, bits: int, n_bytes: int) -> pa.Table:
    """Of one block: its different strings, a row each, and a row of its documents and of where the strings stand."""
    rows = []
    if texts.num_rows:
        block = Block(texts)
        at, hashes = block.samples(width)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        if tied.num_rows:
            known = np.unique(np.concatenate([_unpacked(c, n_bytes) for c in tied.column("hashes").to_pylist()]))
            short = hashes & ~np.uint64((1 << (64 - 8 * n_bytes)) - 1)
            twice |= known[np.minimum(np.searchsorted(known, short), len(known) - 1)] == short
        starts, counts, least = block.strings(width, at[twice])
        raw = block.data.tobytes()
        cells = pa.array([raw[a : a + n + width - 1] for a, n in zip(starts.tolist(), counts.tolist(), strict=True)], pa.binary()).dictionary_encode()
        sids = cells.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first, n = np.unique(sids, return_index=True, return_counts=True)
        key = texts.column("block")[0].as_py()
        bucket = (mix(least[first]) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(first), np.int64)
        rows = [(key, sid, b, c, text, *[None] * 5) for sid, (b, c, text) in enumerate(zip(bucket.tolist(), n.tolist(), cells.dictionary.to_pylist(), strict=True))]
        if len(starts):
            own = np.unique(np.searchsorted(block.offsets, starts, "right") - 1)
            pack = lambda x: x.astype("<i8").tobytes()
            # Of the documents, their starts and ends.
            rows.append((key, -1, 0, 0, None, pack(block.doc_ids[own]), pack(block.keys[own]), pack(np.stack([block.offsets[own], block.offsets[own + 1]], axis=1)), pack(starts), sids.astype("<i4").tobytes()))
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in _STRINGS.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


class Suffixes:
    """The suffixes of a bucket's strings that are `width` bytes long or longer."""

    def __init__(self, strings: pa.Array, width: int) -> None:
        self.data, self.offsets = text_buffers(strings)
        self.data, self.offsets = self.data[self.offsets[0] : self.offsets[-1]], self.offsets - self.offsets[0]
        # Eight bytes from any place on, the first one the most significant.
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self.words = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
        self.width, (self.period, self.residues) = width, cover(width)
        counts = np.diff(self.offsets) - width + 1
        self.places = np.repeat(self.offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        self._rank_samples()

    def word(self, places: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(places, len(self.words) - 1)].astype(np.uint64)

    def _rank_samples(self) -> None:
        """Ranks of the cover samples by their first `covered` bytes, a whole number of periods; what runs over an end is never asked for."""
        v, per = self.period, len(self.residues)
        cycles = -(-max(1, len(self.data)) // v)
        at = (np.arange(cycles)[:, None] * v + self.residues).ravel()
        steps = [*range(0, max(1, v - 7), 8)]
        steps += [v - 8] if v > 8 and steps[-1] != v - 8 else []
        keys = [self.word(at + s) for s in steps]
        if v < 8:
            keys[0] = keys[0] >> np.uint64(64 - 8 * v)
        order = np.lexsort(keys[::-1])
        differs = np.zeros(len(at), bool)
        for key in keys:
            differs[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(differs)

        def then(one: np.ndarray, other: np.ndarray, periods: int) -> np.ndarray:
            """Ranks of strings that begin as `one` says and go on, so many periods later, as `other` says."""
            later = np.zeros(len(one), np.int64)
            later[: max(0, len(one) - periods * per)] = other[periods * per :]
            return np.unique(one * (len(one) + 1) + later, return_inverse=True)[1].astype(np.int64)

        # Doubling, up to the largest number of periods that fits every sample.
        want = (self.width - v + 1) // v
        powers, ranks, done = [(1, rank)], rank, 1
        while 2 * powers[-1][0] <= want:
            n, r = powers[-1]
            powers.append((2 * n, then(r, r, n)))
        done, ranks = powers.pop()
        for n, r in reversed(powers):
            if done + n <= want:
                ranks, done = then(ranks, r, done), done + n
        self.ranks, self.covered = ranks, done * v
        # Offsets from each residue to all samples of the next period, and their numbers.
        ahead = (self.residues[None, :] - np.arange(v)[:, None]) % v
        self.ahead = np.sort(ahead, axis=1)
        self.column = np.argsort(ahead, axis=1, kind="stable")

    def repeated(self, most: int = SORTED) -> np.ndarray:
        """The places whose first `width` bytes are also those of another place, ascending."""
        first = self.word(self.places)
        found = []
        for low, high in _ranges(first, most):
            own = np.flatnonzero((first >= low) & (first <= high))
            found.append(self._repeated_in(self.places[own], first[own]))
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def _repeated_in(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The repeated ones of suffixes that are compared with one another only."""
        at, tie = _still_tied(at, np.zeros(len(at), np.int64), first)
        # The rest of the bytes before the first common sample, at the latest, and those after it.
        ahead = [*range(8, self.period - 1, 8)]
        behind = [*range(self.width - 8, self.covered, -8), self.covered] if self.covered < self.width else []
        for step in [*ahead, *[min(b, self.width - 8) for b in behind]]:
            at, tie = _still_tied(at, tie, self.word(at + step))
        if not len(at):
            return at
        residue = at % self.period
        ahead, column = self.ahead[residue], self.column[residue]
        place = at[:, None] + ahead
        rank = self.ranks[(place // self.period) * len(self.residues) + column]
        # Two suffixes are equal where they have the same rank at the same offset.
        where = (tie[:, None] * self.period + ahead).ravel()
        order = np.lexsort((rank.ravel(), where))
        same = (where[order][1:] == where[order][:-1]) & (rank.ravel()[order][1:] == rank.ravel()[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        return at[twice.reshape(rank.shape).any(axis=1)]


def _ranges(values: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of values that together hold all; about `most` of them each, more only where one value is that frequent."""
    if not len(values):
        return
    step = max(1, len(values) // 4096)
    drawn = np.sort(values[::step])
    cuts = np.unique(drawn[:: max(1, most // step)])
    cuts[0] = 0
    for low, high in zip(cuts, [*(cuts[1:] - np.uint64(1)), np.uint64(0xFFFFFFFFFFFFFFFF)], strict=True):
        yield low, high


def _still_tied(at: np.ndarray, tie: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose tie another with the same key shares, and their new ties; `tie` ascends."""
    if not len(at):
        return at, tie
    order = np.lexsort((key, tie))
    at, tie, key = at[order], tie[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = (tie[1:] != tie[:-1]) | (key[1:] != key[:-1])
    alone = new & np.append(new[1:], True)
    return at[~alone], (np.cumsum(new) - 1)[~alone]


def _spans(places: np.ndarray, width: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin and end within it of the merged spans of `width` bytes from places on; offsets: where texts start, and the end."""
    own = np.searchsorted(offsets, places, "right") - 1
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] > places[:-1] + width) | (own[1:] != own[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(places))[: len(heads)] - 1
    return own[heads], places[heads] - offsets[own[heads]], places[tails] + width - offsets[own[heads]]


def _lists(of: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Different numbers in `of`, which ascends, and lists of the values of each."""
    heads = np.flatnonzero(np.diff(of, prepend=-1))
    cuts = pa.array(np.append(heads, len(of)).astype(np.int32))
    return of[heads], [pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int64))) for v in values]


def _judge(group: pa.Table, width: int) -> pa.Table:
    """Of one bucket's different strings: the spans of each that go."""
    group = group.combine_chunks()
    suffixes = Suffixes(group.column("text").chunk(0), width)
    counts, offsets = group.column("n").to_numpy(), suffixes.offsets
    own, begin, end = _spans(suffixes.repeated(), width, offsets)
    # A string that occurs again goes whole.
    whole = np.flatnonzero(counts > 1)
    rest = counts[own] == 1
    own, begin, end = np.concatenate([own[rest], whole]), np.concatenate([begin[rest], np.zeros(len(whole), np.int64)]), np.concatenate([end[rest], np.diff(offsets)[whole]])
    order = np.argsort(own, kind="stable")
    rows, lists = _lists(own[order], begin[order], end[order])
    return pa.table([group.column("id").take(pa.array(rows)), *lists], names=["id", "begin", "end"])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Two hashes of each suffix of some strings."""
    for batch in batches:
        for row in range(batch.num_rows):
            data, offsets = text_buffers(batch.column(1).slice(row, 1))
            data = data[offsets[0] : offsets[1]]
            at = np.arange(len(data) - width + 1)
            f = []
            for salt, which in ((21, 0), (22, 1)):
                values = _byte_values(False, salt)
                f.append(mix(_rolled(lambda a, b, values=values: values[data[a:b]], at, at + width, which)).view(np.int64))
            ids = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int32)), batch.column(0).slice(row, 1)).dictionary_decode()
            yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(f[0]), pa.array(f[1]), pa.array(np.full(len(at), batch.column(2)[row].as_py(), np.int64))], names=["id", "at", "f1", "f2", "n"])


def _spans_of_rows(group: pa.Table, width: int) -> pa.Table:
    places = np.sort(group.column("at").to_numpy())
    _, begin, end = _spans(places, width, np.array([0, 1 << 62]))
    return pa.table([group.column("id").slice(0, 1), *_lists(np.zeros(len(begin), np.int64), begin, end)[1]], names=["id", "begin", "end"])


def _merge(group: pa.Table) -> pa.Table:
    """Of one block: the spans of each document that go."""
    said, table = {}, None
    for sid, begin, end, ids, keys, ends, starts, sids in zip(*(group.column(n).to_pylist() for n in ("sid", "begin", "end", "doc_ids", "keys", "ends", "starts", "sids")), strict=True):
        if sid < 0:
            table = (*(np.frombuffer(x, "<i8") for x in (ids, keys, ends, starts)), np.frombuffer(sids, "<i4"))
        else:
            said[sid] = np.array(begin), np.array(end)
    ids, keys, ends, starts, sids = table
    ends = ends.reshape(-1, 2)
    begin = np.concatenate([said[s][0] + a for a, s in zip(starts.tolist(), sids.tolist(), strict=True) if s in said] or [np.zeros(0, np.int64)])
    end = np.concatenate([said[s][1] + a for a, s in zip(starts.tolist(), sids.tolist(), strict=True) if s in said] or [np.zeros(0, np.int64)])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    own = np.searchsorted(ends[:, 0], begin, "right") - 1
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > reach[:-1]) | (own[1:] != own[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(begin))[: len(heads)] - 1
    of, lists = _lists(own[heads], begin[heads] - ends[own[heads], 0], reach[tails] - ends[own[heads], 0])
    return pa.table([pa.array(ids[of]), pa.array(keys[of]), *lists], names=["_doc", "_key", "removed_from", "removed_to"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, begin, end in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            data, at, parts = (text or "").encode(), 0, []
            for a, b in zip(begin or (), end or (), strict=True):
                parts.append(data[at:a])
                at = b
            kept.append(b"".join([*parts, data[at:]]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(kept, pa.binary())], names=["doc_id", "text", "removed_from", "removed_to", "kept"])


def repeated_spans(texts: DataFrame, n_bytes: int, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, sample_bucket: int = SAMPLE_BUCKET, suffix_bucket: int = SUFFIX_BUCKET, hot: int = HOT, step_bits: int = STEP_BITS) -> DataFrame:
    """texts: doc_id, text, text_key; n_bytes of them.  _doc, _key, removed_from, removed_to of the documents that have such spans."""
    bits, suffix_bits = (n_bytes // sample_bucket).bit_length(), (n_bytes // suffix_bucket).bit_length()
    short, first_bits = min(8, -(-(BITS + bits) // 8)), min(bits, step_bits)
    placed = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(1 + n_bytes // block_bytes)))

    def samples(group: pa.Table) -> pa.Table:
        hashes = np.unique(Block(group).samples(width)[1])
        return _sample_rows(hashes, np.full(len(hashes), group.column("block")[0].as_py(), np.int64), first_bits, short)

    found = placed.groupBy("block").applyInArrow(samples, _SAMPLES)
    if bits > first_bits:
        found = found.repartition("bucket").mapInArrow(frugal(lambda it: _regroup(it, bits, short)), _SAMPLES)
    tied = found.groupBy("bucket").applyInArrow(lambda t: _tied(t, short), "block long, hashes binary")
    found = placed.groupBy("block").cogroup(tied.groupBy("block")).applyInArrow(lambda a, b: _stretches(a, b, width, suffix_bits, short), _STRINGS)
    stored = Stored(found.withColumn("id", F.unhex(F.md5("text"))))
    strings = stored.table
    named = strings.where("sid >= 0")
    # By the ids alone, which are shorter than the texts.
    size = named.groupBy("bucket", "id").agg(F.max(F.octet_length("text")).alias("size")).groupBy("bucket").agg(F.sum("size").alias("size"))
    large = cut(size.where(F.col("size") > hot).select("bucket"))
    different = named.groupBy("bucket", "text").agg(F.sum("n").alias("n")).withColumn("id", F.unhex(F.md5("text")))
    spans = "id binary, begin array<long>, end array<long>"
    if large.isEmpty():
        judged = different.groupBy("bucket").applyInArrow(lambda t: _judge(t, width), spans)
    else:
        judged = different.join(large, "bucket", "left_anti").groupBy("bucket").applyInArrow(lambda t: _judge(t, width), spans)
        rows = different.join(large, "bucket", "left_semi").select("id", "text", "n").mapInArrow(frugal(lambda it: _fingerprints(it, width)), "id binary, at long, f1 long, f2 long, n long")
        twice = rows.groupBy("f1", "f2").agg(F.sum("n").alias("times")).where("times > 1").select("f1", "f2")
        judged = judged.unionByName(rows.join(twice, ["f1", "f2"], "left_semi").groupBy("id").applyInArrow(lambda t: _spans_of_rows(t, width), spans))
    said = named.select("block", "sid", "id").join(judged, "id").select("block", "sid", "begin", "end")
    answers = said.unionByName(strings.where("sid < 0").select("block", "sid", "doc_ids", "keys", "ends", "starts", "sids"), allowMissingColumns=True)
    merged = answers.groupBy("block").applyInArrow(_merge, "_doc long, _key long, removed_from array<long>, removed_to array<long>")
    # One row of all that are equal, which have the same spans.
    out = cut(merged.dropDuplicates(["_doc", "_key"]))
    stored.clear()
    return out


def suffix_dedup(docs: DataFrame, width: int = WIDTH, **sizes: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, removed_from, removed_to (bytes, end excluded), kept (binary)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spans = repeated_spans(texts, n_bytes, width, **sizes)
    keyed = texts.withColumn("_doc", F.coalesce("doc_id", F.lit(_NO_ID))).withColumnRenamed("text_key", "_key").withColumn("_pair", F.xxhash64("_doc", "_key"))
    # Documents that have no spans for sure are not shuffled.
    told = marked(keyed, spans.select(F.xxhash64("_doc", "_key").alias("_pair")), "_pair", "_maybe")
    near = told.where("_maybe").join(spans, ["_doc", "_key"], "left").select("doc_id", "text", "removed_from", "removed_to")
    near = near.mapInArrow(frugal(_keep), "doc_id long, text string, removed_from array<long>, removed_to array<long>, kept binary")
    none = F.array().cast("array<long>")
    far = told.where("not _maybe").select("doc_id", "text", none.alias("removed_from"), none.alias("removed_to"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept"))
    out = near.withColumns({c: F.coalesce(c, none) for c in ("removed_from", "removed_to")}).unionByName(far)
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "removed_from", "removed_to", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT rid, p, md5(substring(h, 2 * p + 1, 800)) AS f FROM (SELECT rid, h, unnest(generate_series(0, n - 400)) AS p FROM d WHERE n >= 400)),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY f) AS c FROM w) WHERE c > 1),
isle AS (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM rep),
numbered AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM isle),
span AS (SELECT rid, g, min(p) AS a, max(p) + 400 AS b FROM numbered GROUP BY rid, g),
per AS (SELECT rid, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed FROM span GROUP BY rid),
part AS (
  SELECT s.rid, coalesce(lag(b) OVER (PARTITION BY s.rid ORDER BY a), 0) AS x, a AS y FROM span s
  UNION ALL SELECT d.rid, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN span s ON s.rid = d.rid GROUP BY d.rid),
kept AS (SELECT d.rid, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM part JOIN d ON d.rid = part.rid GROUP BY d.rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d LEFT JOIN per ON per.rid = d.rid JOIN kept ON kept.rid = d.rid
"""
