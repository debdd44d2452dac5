"""Vectorised word and word-window hashing over whole Arrow batches.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``; those
bytes never occur inside a multi-byte UTF-8 character, so splitting bytes
equals splitting characters.  Hashes are Rabin-Karp polynomials modulo 2**64
over random per-byte values, finished with an avalanche mix; one prefix sum
gives the hash of every word (and a second one that of every window of words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes of a block of documents; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes or words that one step of hashing takes at a time.  A step needs about 60 bytes for each; what remains is 24 bytes a word.
STEP = 1 << 20

_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=None)
def _byte_values(fold_case: bool, salt: int) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x2545F4914F6CDD1D) + _U(salt))
    if fold_case:
        values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=None)
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, as many as a step needs."""
    found = []
    for base in (_BASE[which], pow(_BASE[which], -1, 1 << 64)):
        p = np.full(STEP + 1, base, np.uint64)
        p[0] = 1
        found.append(np.cumprod(p))
    return found[0], found[1]


def _rolled(values, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hash of values(a, b)[start - a:end - a] for each pair, free of the position; starts and ends ascend.

    `values` gives the numbers of a range of places.  Pairs are taken in steps
    of STEP places, and a longer pair is put together from several steps.
    """
    up, down = _powers(which)
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + STEP, "right")))
        b = int(ends[j - 1])
        if b - a <= STEP:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(values(a, b) * up[: b - a], out=sums[1:])
            out[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * down[starts[i:j] - a]
        else:
            factor, step = 1, pow(_BASE[which], STEP, 1 << 64)
            total = 0
            for at in range(a, b, STEP):
                part = values(at, min(b, at + STEP))
                total = (total + int((part * up[: len(part)]).sum(dtype=np.uint64)) * factor) % (1 << 64)
                factor = factor * step % (1 << 64)
            out[i] = total
        i = j
    return out


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_INSIDE = (~_SEPARATOR).astype(np.uint8)


@dataclass
class Words:
    """The words of a block of documents, in order."""

    data: np.ndarray  # the block's bytes
    doc_ids: np.ndarray  # id of each document of the block
    starts: np.ndarray  # byte at which each word starts
    ends: np.ndarray
    first: np.ndarray  # first word of each document, and the number of words at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.doc_ids)), self.counts())

    def hashes(self, fold_case: bool = False, salt: int = 0) -> np.ndarray:
        return self.parts(self.starts, self.ends, fold_case, salt)

    def parts(self, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False, salt: int = 0) -> np.ndarray:
        """Hash of the bytes of each pair of places; both ascend."""
        values = _byte_values(fold_case, salt)
        return mix(_rolled(lambda a, b: values[self.data[a:b]], starts, ends, 0) + (ends - starts).astype(np.uint64))

    def windows(self, width: int, hashes: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every window of `width` words inside one document, and the word it starts at."""
        n = len(hashes)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # Windows that start in the last width - 1 words of a document would reach into the next one.
        inside = np.ones(n, bool)
        for back in range(1, width):
            ends = self.first[1:] - back
            inside[ends[ends >= self.first[:-1]]] = False
        at = np.flatnonzero(inside)
        rolled = _rolled(lambda a, b: hashes[a:b], at, at + width, 1)
        return mix(rolled ^ _U(salt * 2 + 1)), at

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """Hash of each document's whole word sequence."""
        return mix(_rolled(lambda a, b: hashes[a:b], self.first[:-1], self.first[1:], 1) + _U(7) * self.counts().astype(np.uint64))


def _cut(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of one kind, kind 0 being no word; offsets are cuts as well."""
    starts, ends = [], []
    for at in range(0, len(data), STEP):
        top = min(len(data), at + STEP)
        # One more byte on each side says whether a run goes on.
        kind = kinds[data[max(0, at - 1) : min(len(data), top + 1)]]
        begins = np.ones(len(kind) + 1, bool)
        begins[1:-1] = kind[1:] != kind[:-1]
        low = max(0, at - 1)
        cuts = offsets[(offsets >= low) & (offsets <= low + len(kind))] - low
        begins[cuts] = True
        word = kind > 0
        own = slice(at - low, top - low)
        starts.append(np.flatnonzero(begins[:-1][own] & word[own]) + at)
        ends.append(np.flatnonzero(begins[1:][own] & word[own]) + at + 1)
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def split(data: np.ndarray, offsets: np.ndarray, doc_ids: np.ndarray) -> Words:
    """offsets: where each document starts in data, and the end."""
    starts, ends = _cut(data, offsets, _INSIDE)
    return Words(data, doc_ids, starts, ends, np.searchsorted(starts, offsets))


_CLASS = np.full(256, 2, np.uint8)
_CLASS[_SEPARATOR] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def split_classes(data: np.ndarray, offsets: np.ndarray, doc_ids: np.ndarray) -> Words:
    """Like split, with runs of letters and digits and runs of punctuation as words of their own."""
    starts, ends = _cut(data, offsets, _CLASS)
    return Words(data, doc_ids, starts, ends, np.searchsorted(starts, offsets))


_TERM = np.zeros(256, np.uint8)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def split_terms(data: np.ndarray, offsets: np.ndarray, doc_ids: np.ndarray) -> Words:
    """Like split, but words are runs of digits, Latin letters and bytes beyond ASCII alone."""
    starts, ends = _cut(data, offsets, _TERM)
    return Words(data, doc_ids, starts, ends, np.searchsorted(starts, offsets))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty, without copying where possible."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    return np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8), at.astype(np.int64)


def blocks(batch: pa.RecordBatch, text: str = "text", id_column: str = "doc_id", cut=split, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for runs of rows of about `size` bytes of text; a document is never split, but hashed in steps."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    ids = batch.column(batch.schema.get_field_index(id_column)).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, n)
        at = offsets[row : end + 1]
        yield row, end, cut(data[at[0] : at[-1]], at - at[0], ids[row:end])
        row = end
