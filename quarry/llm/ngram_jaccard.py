"""N-gram Jaccard join: documents whose sets of word shingles are similar, and their components.

A document's set holds the hashes of its different `width`-word shingles.
Equal sets are one node.  Two nodes link when the Jaccard similarity of their
sets reaches `percent`.

* Tiles.  Each set is ordered by hash, shingles that very many documents hold
  last, and its first shingles name the tiles it belongs to; all members of a
  tile hold its shingle.  The prefix of `n - ceil(0.75 n) + 1` shingles loses
  no link; a shorter one is taken only where the chance that a linked pair
  shares none of it is below 1e-18, less than that of a hash collision.  A
  tile of more than `block` members is cut into size bands, as sizes of linked
  sets differ by a third at most, and these into blocks, every pair of which
  is a tile of its own, so that one shingle's members spread over many tasks.
* Bit counts.  Each set carries a hashed parity bitmap of two bits or more per
  shingle.  Each differing bit proves a shingle that one set lacks, so the
  overlap is at most (n_a + n_b - differing bits) / 2.
* Exact verification.  What passes is decided by intersecting the sorted
  arrays of both texts.  Texts travel for that, not arrays, as they are
  smaller; a text that many pairs name travels once for every GROUP of them.

A large group of similar documents need not emit all its pairs.  First every
member of a tile is tried with the smallest document that its bits allow.
Only tiles that then hold several components go on, with the pairs between
components.  A tile with more than `per_member` of them per member hands out a slice
of these at a time, and links found in one slice spare those of the next;
when the last slice has been tried, every allowed pair is either tried or
inside one component.

Defined results: null, empty or blank texts have an empty set and link with
nothing; with fewer words than `width` the whole sequence is the one shingle;
repeated rows come back each, rows that share a doc_id count as one document;
a row without doc_id links with nothing and has no component; other columns
are ignored.  A very long text is hashed in steps; the task that does so needs
some ten bytes for each of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, frugal, possible, small_batches
from .wordhash import Words, blocks, mix

WIDTH, PERCENT = 5, 75
#: A shingle that names more tile members than this is ordered last.
CROWD = 400
#: A tile of uncrowded shingles may grow to this size before their order is settled anew, which is done REORDERS times at most.
TILE, REORDERS = 4000, 2
#: Members of one block of a large tile; pairs per member that a tile hands out at a time; pairs for which one text travels once.
BLOCK, PAIRS, GROUP = 2048, 32, 64
#: A shingle in this many documents of one block is counted across blocks; bytes of text of such a block, and of those of other steps.
LOCAL_CROWD, COUNT_BYTES, BLOCK_BYTES = 3, 2 << 20, 1 << 20
#: Bits of the map of crowded shingles: fixed, so what is sent to every task is 4 MB at any size.  A false hit only changes the order, alike for all sets.
MAP_BITS = 1 << 25
_CELL = 32_768
#: Log of the chance that a shortened prefix may miss a link.
_MISS = 18 * math.log(10)

_PROFILE = "doc_id long, n int, s1 long, s2 long, tokens array<long>, bits binary"
_U = np.uint64


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the documents of a block, one after the other, and where each document's start."""
    hashes = words.hashes(fold_case=True)
    window, at = words.windows(width, hashes)
    owner = words.owner()[at]
    short = np.flatnonzero((words.counts() > 0) & (words.counts() < width))
    if len(short):
        window = np.concatenate([window, words.whole(hashes)[short]])
        owner = np.concatenate([owner, short])
    order = np.lexsort((window, owner))
    window, owner = window[order], owner[order]
    if len(window):
        fresh = np.ones(len(window), bool)
        fresh[1:] = (window[1:] != window[:-1]) | (owner[1:] != owner[:-1])
        window, owner = window[fresh], owner[fresh]
    return window, np.searchsorted(owner, np.arange(len(words.doc_ids) + 1))


def prefix_length(n: int, rare: int, percent: int) -> int:
    """Shingles that name tiles, of n, `rare` of which are not crowded."""
    exact = n - -(-percent * n // 100) + 1
    # Of a linked pair's uncrowded shingles at most this fraction is in one set only.
    apart = (100 - percent) / percent * n / rare if rare else 1.0
    return exact if apart >= 1 else min(exact, math.ceil(_MISS / -math.log(apart)))


def bitmap_width(n: int) -> int:
    return 1 << max(6, (2 * n - 1).bit_length())


def parity_bitmap(hashes: np.ndarray) -> np.ndarray:
    """Packed bits, each the parity of the number of hashes that fall on it."""
    width = bitmap_width(len(hashes))
    return np.packbits(np.bincount((mix(hashes) & _U(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1)


def _crowded(hashes: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    if bits is None:
        return np.zeros(len(hashes), bool)
    at = hashes & _U(MAP_BITS - 1)
    return (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _profile(batches: Iterator[pa.RecordBatch], width: int, percent: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, words in blocks(batch, size=BLOCK_BYTES):
            sets, at = shingle_sets(words, width)
            crowded = _crowded(sets, bits)
            first, second = mix(sets ^ _U(0xA5A5A5A5)), mix(sets + _U(0x5DEECE66D))
            sums = [np.concatenate(([0], np.cumsum(x))).astype(np.uint64) for x in (first, second)]
            keys = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
            tokens, maps = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own, hot = sets[a:b], crowded[a:b]
                rare = own[~hot]
                k = prefix_length(b - a, len(rare), percent) if b > a else 0
                named = rare[:k] if len(rare) >= k else np.concatenate([rare, own[hot][: k - len(rare)]])
                tokens.append(named.view(np.int64))
                maps.append(parity_bitmap(own).tobytes() if b > a else b"")
            lengths = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.doc_ids), pa.array(np.diff(at).astype(np.int32)), pa.array(keys[0]), pa.array(keys[1]), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)), pa.array(maps, pa.binary())],
                names=["doc_id", "n", "s1", "s2", "tokens", "bits"],
            )


def _local_crowds(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, words in blocks(batch, size=COUNT_BYTES):
            found, count = np.unique(shingle_sets(words, width)[0], return_counts=True)
            many = count >= LOCAL_CROWD
            yield pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(count[many].astype(np.int64))], names=["token", "c"])


def _as_map(tokens: DataFrame) -> np.ndarray:
    """The map of crowded shingles: MAP_BITS bits, whatever the number of tokens."""
    bit = F.pmod("token", F.lit(MAP_BITS))
    cells = tokens.select((F.floor(bit / _CELL)).cast("int").alias("cell"), (bit % _CELL).alias("bit")).groupBy("cell").agg(F.expr("bitmap_construct_agg(bit)").alias("map"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for row in cells.toLocalIterator():
        out[row["cell"] * (_CELL // 8) : (row["cell"] + 1) * (_CELL // 8)] = np.frombuffer(row["map"], np.uint8)
    return out


class _Tiles:
    """Whole tiles, one after the other, each in order of doc_id."""

    def __init__(self, rows: pa.Table, percent: int) -> None:
        self.token, cell, self.doc, n, self.label, side = (rows.column(c).to_numpy() for c in ("token", "cell", "doc_id", "n", "label", "side"))
        self.n, self.side, self.percent = n.astype(np.int64), side, percent
        fresh = np.ones(len(cell), bool)
        fresh[1:] = (cell[1:] != cell[:-1]) | (self.token[1:] != self.token[:-1])
        self.tile = np.cumsum(fresh) - 1
        self.start = np.flatnonzero(fresh)
        self.end = np.append(self.start[1:], len(cell))[self.tile]
        bits = rows.column("bits").to_pylist()
        self.width = np.array([len(b) // 8 for b in bits])
        self.place = np.empty(len(bits), np.int64)
        self.maps = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.maps[w] = np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), w)

    def allowed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sizes and bit counts leave it open that the rows i and j link."""
        out = 100 * np.minimum(self.n[i], self.n[j]) >= self.percent * np.maximum(self.n[i], self.n[j])
        at = np.flatnonzero(out)
        i, j = i[at], j[at]
        wide, narrow = np.where(self.width[i] >= self.width[j], i, j), np.where(self.width[i] >= self.width[j], j, i)
        names = self.width[wide] * (1 << 32) + self.width[narrow]
        for name in np.unique(names).tolist():
            w, v = name >> 32, name & 0xFFFFFFFF
            own = np.flatnonzero(names == name)
            for k in range(0, len(own), max(1, (1 << 19) // w)):
                part = own[k : k + max(1, (1 << 19) // w)]
                a = self.maps[w][self.place[wide[part]]]
                while a.shape[1] > v:
                    # The parity of two bits that a narrower map holds as one is their exclusive or.
                    a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
                apart = np.bitwise_count(a ^ self.maps[v][self.place[narrow[part]]]).sum(axis=1, dtype=np.int64)
                both = self.n[wide[part]] + self.n[narrow[part]]
                # Overlap at most (both - apart) / 2; 100 overlap >= percent * (both - overlap).
                out[at[part]] = (100 + self.percent) * (both - apart) >= 2 * self.percent * both
        return out

    def stars(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each row with the first of its tile that allows it, unless that one has such a row itself."""
        left = np.arange(len(self.doc))
        while len(left):
            first = np.ones(len(left), bool)
            first[1:] = self.tile[left[1:]] != self.tile[left[:-1]]
            heads = np.flatnonzero(first)
            head = left[np.repeat(heads, np.diff(np.append(heads, len(left))))]
            rest = np.flatnonzero(~first)
            i, j = head[rest], left[rest]
            ok = self.allowed(i, j)
            yield i[ok], j[ok]
            left = j[~ok]

    def between(self, slice_: int, slices: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All allowed pairs of different labels, or those of one slice."""
        i = np.arange(len(self.doc))
        t = 0
        while len(i):
            t += 1
            i = i[i + t < self.end[i]]
            j = i + t
            ok = (self.label[i] != self.label[j]) & ((self.side[i] == 0) | (self.side[i] != self.side[j]))
            if slices > 1:
                ok &= self.slice_of(i, j) % _U(slices) == _U(slice_)
            a, b = i[ok], j[ok]
            ok = self.allowed(a, b)
            yield a[ok], b[ok]

    def slice_of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.doc[i], self.doc[j]), np.maximum(self.doc[i], self.doc[j])
        return mix(mix(low.view(np.uint64)) + high.view(np.uint64))


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (token, cell), cut between tiles."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        token, cell = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("token", "cell"))
        if kept and (token[0], cell[0]) != seen:  # noqa: F821
            yield pa.Table.from_batches(kept)
            kept = []
        cuts = np.flatnonzero((token[1:] != token[:-1]) | (cell[1:] != cell[:-1])) + 1
        if len(cuts):
            yield pa.Table.from_batches([*kept, batch.slice(0, int(cuts[-1]))])
            kept = []
        kept.append(batch.slice(int(cuts[-1]) if len(cuts) else 0))
        seen = (token[-1], cell[-1])  # noqa: F841
    if kept:
        yield pa.Table.from_batches(kept)


_PAIRS = "a long, b long, slices int"


def _compared(batches: Iterator[pa.RecordBatch], percent: int, per_member: int, mode: str, slice_: int = 0, slices: int = 1) -> Iterator[pa.RecordBatch]:
    """Pairs a < b to be verified (slices 0); of a tile with too many of them a slice, and a row (token, null, slices)."""

    def rows(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.array(n.astype(np.int32))], names=["a", "b", "slices"])

    for table in _whole_tiles(batches):
        tiles = _Tiles(table, percent)
        found = list(tiles.stars() if mode == "stars" else tiles.between(slice_, slices))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        if mode == "first":
            per_tile = np.bincount(tiles.tile[i], minlength=len(tiles.start))
            members = np.bincount(tiles.tile, minlength=len(tiles.start))
            parts = -(-per_tile // (per_member * members))
            ok = (parts[tiles.tile[i]] <= 1) | (tiles.slice_of(i, j) % np.maximum(1, parts[tiles.tile[i]]).astype(np.uint64) == 0)
            i, j, many = i[ok], j[ok], np.flatnonzero(parts > 1)
            yield rows(tiles.token[tiles.start[many]], None, parts[many])
        a, b = np.minimum(tiles.doc[i], tiles.doc[j]), np.maximum(tiles.doc[i], tiles.doc[j])
        yield rows(a[a != b], b[a != b], np.zeros(int((a != b).sum())))


def _spread(members: DataFrame, cells: Column) -> DataFrame:
    return members.withColumn("_at", F.explode(cells)).select("token", "doc_id", "n", "label", "bits", F.col("_at.cell").alias("cell"), F.col("_at.side").alias("side"))


def _star_cells(block: int) -> Column:
    """One cell for each block of a tile; its smallest document is in all of them."""
    blocks = F.ceil(F.col("c") / block).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    of = F.when(F.col("c") <= block, F.array(F.lit(0))).when(F.col("doc_id") == F.col("pivot"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    return F.transform(of, lambda x: F.struct(x.cast("long").alias("cell"), F.lit(0).alias("side")))


def _pair_cells(block: int, percent: int) -> Column:
    """The cells in which a row meets those of its tile that may link with it: all of a small tile, pairs of blocks of one or two neighbouring size bands of a large one.

    side is 0 where all rows of the cell meet, else 1 or 2, which meet each other.
    """
    blocks = F.ceil(F.col("c") / block).cast("long")
    own = F.pmod(F.xxhash64("doc_id"), blocks)
    # Sizes of linked sets are in one band or in neighbouring ones; the small summand keeps a rounded logarithm from skipping a band.
    band = F.floor(F.log(F.col("n")) / (math.log(100 / percent) + 1e-9))

    def cell(g: Column, next_band: int, x: Column, y: Column, side: Column) -> Column:
        return F.struct((((g * 2 + next_band) * (1 << 20) + x) * (1 << 20) + y).alias("cell"), side.cast("int").alias("side"))

    all_blocks = F.sequence(F.lit(0).cast("long"), blocks - 1)
    same = F.transform(all_blocks, lambda o: cell(band, 0, F.least(own, o), F.greatest(own, o), F.when(own == o, 0).when(own < o, 1).otherwise(2)))
    up = F.transform(all_blocks, lambda o: cell(band, 1, own, o, F.lit(1)))
    down = F.transform(all_blocks, lambda o: cell(band - 1, 1, o, own, F.lit(2)))
    return F.when(F.col("c") <= block, F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side")))).otherwise(F.concat(same, up, down))


def _links(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """a, chunk, doc_id, text sorted so that a's own text comes first in its chunk; a, b of the pairs that link, out."""
    group, leaders = None, []
    for batch in batches:
        sets, chunk = [], batch.column(1).to_pylist()
        for _, _, words in blocks(batch, size=BLOCK_BYTES):
            flat, cuts = shingle_sets(words, width)
            sets += [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        found = []
        for a, c, b, own in zip(batch.column(0).to_pylist(), chunk, batch.column(2).to_pylist(), sets, strict=True):
            if (a, c) != group:
                group, leaders = (a, c), []
            if a == b:
                leaders.append(own)
            elif any(_linked(x, own, percent) for x in leaders):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """x, y: sorted arrays."""
    if not len(x) or not len(y):
        return False
    place = np.searchsorted(x, y)
    place[place == len(x)] = 0
    common = int(np.count_nonzero(x[place] == y))
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs a, b of doc_ids that link; texts: doc_id, text."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("c"))
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / GROUP)).alias("chunk")
    groups = pairs.join(counts, "a").select("a", "b", chunk).groupBy("a", "chunk").agg(F.collect_list("b").alias("bs"))
    asked = groups.select("a", "chunk", F.explode(F.concat(F.array("a"), "bs")).alias("doc_id"))
    # Only texts that some pair names are shuffled.
    named = possible(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), "doc_id")
    both = asked.join(named, "doc_id").select("a", "chunk", "doc_id", "text").repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("doc_id") != F.col("a"))
    return both.mapInArrow(frugal(lambda it: _links(it, width, percent)), "a long, b long").distinct()


def ngram_jaccard(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, crowd: int = CROWD, tile_size: int = TILE, block: int = BLOCK, per_member: int = PAIRS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reached), n_links.

    n_links counts the links that were verified for the document's set; a
    component is settled without trying all its pairs.
    """
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")

    # Shingles that crowd tiles: by what blocks count, then by the tiles themselves.
    local = texts.mapInArrow(frugal(lambda it: _local_crowds(it, width)), "token long, c long")
    bits = _as_map(local.groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") > crowd))
    for turn in range(REORDERS + 1):
        shared_bits = docs.sparkSession.sparkContext.broadcast(bits)
        base = cut(texts.mapInArrow(frugal(lambda it, sent=shared_bits: _profile(it, width, percent, sent.value)), _PROFILE))
        sets = cut(base.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")))
        own = base.where("n > 0").join(sets.withColumnRenamed("rep", "doc_id"), ["doc_id", "s1", "s2"], "left_semi")
        own = own.select("doc_id", F.explode("tokens").alias("token"))
        tiles = cut(own.groupBy("token").agg(F.count("*").alias("c"), F.min("doc_id").alias("pivot")).where("c > 1"))
        more = _as_map(tiles.where(F.col("c") > tile_size).select("token")) | bits if turn < REORDERS else bits
        if (more == bits).all():
            break
        bits = more
    members = cut(own.join(tiles, "token").select("token", "doc_id", "c", "pivot"))
    maps = base.where("n > 0").select("doc_id", "n", "bits")

    def compared(rows: DataFrame, *mode) -> DataFrame:
        rows = rows.repartition("token", "cell").sortWithinPartitions("token", "cell", "doc_id")
        return rows.mapInArrow(frugal(lambda it: _compared(it, percent, per_member, *mode)), _PAIRS).distinct()

    stars = _spread(members.join(maps, "doc_id").withColumn("label", F.col("doc_id")), _star_cells(block))
    tried = cut(compared(stars, "stars").select("a", "b"))
    links = cut(verified(tried, texts, width, percent))
    roots = components(links)

    def open_tiles(only: DataFrame | None) -> DataFrame:
        """Rows of the tiles, or of some of them, that hold several components."""
        some = members if only is None else members.join(only, "token", "left_semi")
        labelled = some.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("token", "doc_id", "c", F.coalesce("component", "doc_id").alias("label"))
        split = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("token")
        return _spread(labelled.join(split, "token", "left_semi").join(maps, "doc_id"), _pair_cells(block, percent))

    def settle(found: DataFrame) -> None:
        nonlocal tried, links, roots
        found = cut(found.join(tried, ["a", "b"], "left_anti"))
        if found.isEmpty():
            return
        new = cut(verified(found, texts, width, percent))
        tried = tried.unionByName(found)
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = components(links)

    found = cut(compared(open_tiles(None), "first"))
    settle(found.where("slices = 0").select("a", "b"))
    crowds = found.where("slices > 0").groupBy(F.col("a").alias("token")).agg(F.max("slices").alias("slices"))
    slices = crowds.agg(F.max("slices")).first()[0] or 0
    for k in range(slices):
        settle(compared(open_tiles(crowds.select("token")), "slice", k, slices).select("a", "b"))

    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = sets.join(roots.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"), "n_links")
    rows = base.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    linked = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    if docs.where("doc_id is null").isEmpty():
        return linked
    null = F.lit(None).cast("long")
    orphans = docs.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(frugal(lambda it: _profile(it, width, percent, None)), _PROFILE)
    return linked.unionByName(orphans.select(null.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), null.alias("component_id"), F.lit(0).cast("long").alias("n_links")))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, list_aggregate(ws[i : i + 4], 'string_agg', ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, list_aggregate(ws, 'string_agg', ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM reach JOIN link ON x = id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM reach WHERE id = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""
