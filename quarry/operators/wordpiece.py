"""Subword tokens by greedy longest match (WordPiece), with a vocabulary that the caller gives.

Texts are cleaned of control characters and split at white space; every
punctuation character and every CJK character is a word of its own.  A word is
then cut into the longest piece of the vocabulary it begins with, and the
longest pieces that continue it, which are marked by a prefix; a word that
cannot be cut so to its end, or is too long, is the unknown token.  Case and
accents stay.

Nothing about a text is kept but the ids of its different words, so tasks
encode each word once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: CJK ideographs, each a word of its own.
CJK = "一-鿿㐀-䶿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b920-\U0002ceaf豈-﫿\U0002f800-\U0002fa1f"
_PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
_WORD = regex.compile(rf"[{CJK}]|[{_PUNCTUATION}]|[^\s{CJK}{_PUNCTUATION}]+")
_CONTROLS = regex.compile(r"[^\P{C}\t\n\r]|�")
#: What follows a word without a blank in decoded text.
CLOSED = {" .": ".", " ?": "?", " !": "!", " ,": ",", " n't": "n't", " 'm": "'m", " 's": "'s", " 've": "'ve", " 're": "'re"}
#: Different words whose ids a task remembers.
REMEMBERED = 1 << 17


@dataclass(frozen=True)
class WordPiece:
    """pieces: the vocabulary, a piece's id being its place."""

    pieces: tuple[str, ...]
    unknown: str = "[UNK]"
    prefix: str = "##"
    longest_word: int = 100
    special: tuple[str, ...] = ("[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]")
    _known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.unknown not in self.pieces:
            raise ValueError(f"the vocabulary lacks {self.unknown}")

    def __getstate__(self) -> dict:
        # What is derived is made anew in each worker.
        return {k: v for k, v in self.__dict__.items() if k not in ("_trie", "_ids", "_shown")} | {"_known": {}}

    @classmethod
    def read(cls, spark, path: str, most: int = 1_000_000, **options) -> WordPiece:
        """A vocabulary file with a piece per line, in the order of ids; an error beyond `most` lines."""
        lines = spark.read.text(path, wholetext=True).select("value").limit(1).first()[0].split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        if len(lines) > most:
            raise ValueError(f"more than {most} pieces")
        return cls(tuple(x.rstrip("\r") for x in lines), **options)

    @cached_property
    def _ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces)}

    @cached_property
    def _trie(self) -> tuple[dict, dict]:
        """Tries of the pieces that begin a word and of those that continue one; the id of a piece stands under the empty string."""
        roots: tuple[dict, dict] = ({}, {})
        for i, piece in enumerate(self.pieces):
            inside = piece.startswith(self.prefix) and len(piece) > len(self.prefix)
            for root, text in ((roots[0], piece), *(((roots[1], piece[len(self.prefix) :]),) if inside else ())):
                for c in text:
                    root = root.setdefault(c, {})
                root[""] = i
        return roots

    @cached_property
    def _shown(self) -> tuple[list[str | None], list[str]]:
        """The text of each id as the first one, null of special ones, and behind others."""
        special = set(self.special)
        first = [None if p in special else CLOSED.get(p, p) for p in self.pieces]
        behind = [p[len(self.prefix) :] if p.startswith(self.prefix) else f" {p}" for p in self.pieces]
        return first, ["" if f is None else CLOSED.get(p, p) for f, p in zip(first, behind, strict=True)]

    def _of_word(self, word: str) -> tuple[int, ...]:
        unknown = (self._ids[self.unknown],)
        if len(word) > self.longest_word:
            return unknown
        out, at, length, (root, inside) = [], 0, len(word), self._trie
        while at < length:
            node, found, i = inside if at else root, None, at
            while i < length and (node := node.get(word[i])) is not None:
                i += 1
                if "" in node:
                    found = i, node[""]
            if found is None:
                return unknown
            at = found[0]
            out.append(found[1])
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in _WORD.findall(_CONTROLS.sub("", text)):
            ids = self._known.get(word)
            if ids is None:
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                ids = self._known[word] = self._of_word(word)
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids without special tokens; blanks stand where words began, but not before closing punctuation."""
        first, later = self._shown
        for n, i in enumerate(ids):
            if first[i] is not None:
                return first[i] + "".join([later[x] for x in ids[n + 1 :]])
        return ""

    def ids(self, text: Column | str) -> Column:
        """The ids of each text; null stays null."""
        return F.arrow_udf(lambda texts: pa.array([None if t is None else self.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32())), "array<int>")(text)

    def count(self, text: Column | str) -> Column:
        """The number of tokens of each text, for budgets; null has none."""
        return F.arrow_udf(lambda texts: pa.array([0 if t is None else len(self.encode(t)) for t in texts.to_pylist()], pa.int32()), "int")(text)

    def text(self, ids: Column | str) -> Column:
        """The text of each array of ids."""
        return F.arrow_udf(lambda rows: pa.array([None if r is None else self.decode(r) for r in rows.to_pylist()], pa.string()), "string")(ids)


def with_counts(chunks: DataFrame, codec: WordPiece, text: str = "chunk_text", name: str = "tokens") -> DataFrame:
    """The chunks with their numbers of tokens, as `fusion.within_budget` takes them."""
    return chunks.withColumn(name, codec.count(text))
