"""Byte-level BPE encoding and decoding through a sentencepiece model built from a rank file.

The model is serialised directly from the vocabulary: byte-mapped pieces in
rank order, so that ids equal ranks, each scored by its negative rank; the
normaliser is the identity.  Texts are cut into pre-tokens, each distinct one
of a task is encoded once, and ids decode through the inverse mapping.

Defined results: a null text is an empty one and gives no ids; special tokens
do not exist, so their strings are ordinary text; rows are handled one by
one, so repeated ids, other columns and empty tables need no special case.  A
very long text is cut and encoded piece by piece, each of whole pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import frugal, small_batches

#: Bytes that a worker's remembered pre-tokens may take, about; beyond it the memory starts anew.
MEMO_BYTES = 40 << 20
#: Pre-tokens of a text encoded at a time, and the characters of a text that is not cut into such pieces.
PIECE, SHORT_TEXT = 1 << 16, 1 << 18


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """Serialised model whose piece ids are the ranks; the unknown piece that the format asks for comes last.

    Fields of the public sentencepiece_model.proto.
    """
    alphabet = byte_alphabet()
    pieces = [b""] * len(ranks)
    for token, rank in ranks.items():
        mapped = "".join(alphabet[b] for b in token).encode()
        pieces[rank] = _field(1, _field(1, mapped) + _field(2, -float(rank)) + _field(3, 1))
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    off = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_field(n, off) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = [b""] * len(ranks)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.translate = str.maketrans(dict(enumerate(byte_alphabet())))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.pattern = regex.compile(pattern)
        # A pre-token that is itself in the vocabulary is one token, whether or not merges lead to it.
        self.ids = list(range(len(ranks) + 1))  # one object per id, which all remembered pre-tokens share
        self.whole = {text: (self.ids[rank],) for token, rank in ranks.items() if (text := token.decode(errors="replace")).encode() == token}
        self.forget()

    def cut(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in pieces."""
        if len(text) <= SHORT_TEXT:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while piece := list(islice(found, PIECE)):
            yield piece

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in pieces."""
        for words in self.cut(text):
            if self.size > MEMO_BYTES:
                self.forget()
            memo = self.memo
            new = list(set(words).difference(memo))
            if new:
                mapped = [w.encode().decode("latin-1").translate(self.translate) for w in new]
                found = self.model.encode(mapped, num_threads=1)
                memo.update((w, tuple(map(self.ids.__getitem__, ids))) for w, ids in zip(new, found, strict=True))
                # A string, a tuple and an entry of the table, and what they hold.
                self.size += 200 * len(new) + 2 * sum(map(len, new)) + 8 * sum(map(len, found))
            yield list(chain.from_iterable(map(memo.__getitem__, words)))

    def forget(self) -> None:
        self.memo, self.size = dict(self.whole), 0

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(read_ranks(ranks), pattern)


def byte_bpe(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (null unless with_ids), ids_sha256, decoded_sha256.

    `rank_file` is a local path on the driver; its bytes (under 1 MB for 50,000 tokens) travel with the task.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids_hash, text_hash, kept = [], [], [], []
                for text in part.column(1).to_pylist():
                    of_ids, of_text, pieces = hashlib.sha256(), hashlib.sha256(), [np.zeros(0, np.int32)]
                    for ids in codec.encode(text or ""):
                        of_ids.update(("," * (len(pieces) > 1) + ",".join(map(str, ids))).encode())
                        of_text.update(codec.decode(ids))
                        pieces.append(np.array(ids, np.int32))
                    kept.append(np.concatenate(pieces))
                    n.append(len(kept[-1]))
                    ids_hash.append(of_ids.hexdigest())
                    text_hash.append(of_text.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(kept if with_ids else [None] * len(n), pa.list_(pa.int32())), pa.array(ids_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select(docs.doc_id.cast("long").alias("doc_id"), docs.text).mapInArrow(frugal(run), "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
