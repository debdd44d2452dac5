"""Line dedup across the corpus: exact and fuzzy lines by MinHash (native).

1. Every line becomes its character shingles, which come from its UTF-16 bytes
   at fixed offsets, and its MinHash signature is an aggregation over all of
   them, several to a row, with map-side combine; equal lines collapse in it.
2. The first and the last shingle of an order, which goes by 32 bits of a hash,
   are two MinHashes.  They form GROUPS groups of EACH, and every two groups are a band: from
   12 MinHashes come 15 bands of 4, which find as much as 7 bands of 28.
   Bands find candidates.  First a bucket pairs each line with its first line
   or, where sketches of the MinHashes speak against that, with the one before
   it.
3. A parity bitmap of every line that has a bucket mate, as wide as the line
   needs, bounds similarities from above.  Pairs that it leaves open are verified by the exact Jaccard
   similarity of their shingles.  Buckets that then hold lines of several
   components go on with the pairs of different components that the bitmaps
   leave open: first a sample of these, whose links spare most of the others,
   then all that remain, so a line meets every bucket mate it may resemble.
4. Components of similar lines keep one line, the first by (doc_id, position);
   all other occurrences go.

A pair of similarity 0.8 / 0.85 / 0.9 meets in some band with a chance of
0.975 / 0.992 / 0.999.

Defined results: lines are split at ``\\n`` and compared without white space
around them; blank lines stay; a document all of whose lines go keeps an empty
text; a null text stays null; rows that repeat a doc_id keep each other's
lines, as they are the same document; a row without doc_id comes last; a
line shorter than a shingle is one shingle; other columns pass through, whatever
their names.  A line is known by a 64-bit hash; where a second hash shows that
two different lines share one, lines of that hash all stay.  Signing
streams the shingles of a long line; only one that has a bucket mate is held
with all of them, 8 bytes each.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import cut, possible

SHINGLE, THRESHOLD = 6, 0.8
#: Groups of MinHashes, and MinHashes of each; shingles of one row.
GROUPS, EACH, BATCH = 6, 2, 8
BANDS = GROUPS * (GROUPS - 1) // 2
#: Of a sketch: bits of a MinHash, and how many MinHashes may differ; similar lines hardly ever differ in more.  That only decides what is tried first.
FIELD, SKETCH_MISSES = 5, 5
#: Words of 64 bits of a line's parity bitmap, up to which length that is enough (a bit per character), and lines of a bucket in one block, whose pairs with another block one task compares.
PARITY_WORDS, NARROW, BLOCK = 16, 1024, 2048
#: Rows of a task over what is cut, where it is narrow.
ROWS = 100_000
#: Of so many open pairs one is in the sample.
SAMPLE = 16
#: Lines whose sets of shingles one task makes; shingles of one row then.
LINES_OF_TASK, SET_BATCH = 4000, 16

LAST = 2**63 - 1


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """doc, key of the text, position, line of each line that is not blank."""
    split = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    # Trimming other characters than blanks reads the whole line, so only lines that need it pay for it.
    plain, other = F.trim("raw"), "\t\r\v\f"
    edged = reduce(or_, [plain.startswith(c) | plain.endswith(c) for c in other])
    line = F.when(edged, F.btrim("raw", F.lit(" " + other))).otherwise(plain)
    return split.withColumn("line", line).where("line != ''").select("doc", "text_key", "pos", "line", F.xxhash64("line").alias("k"))


def _last(utf16: Column, shingle: int) -> Column:
    """First byte, from 1, of a line's last shingle."""
    return F.greatest(F.octet_length(utf16) - 2 * shingle + 1, F.lit(1))


def _shingles(utf16: str, i: str, shingle: int, batch: int = SET_BATCH) -> Column:
    """The shingles of the i-th row of a line, from 0; the last row repeats the last one."""
    last = _last(F.col(utf16), shingle)
    return F.array(*[_shingle(F.col(utf16), F.least(F.col(i) * (2 * batch) + 2 * t + 1, last), shingle) for t in range(batch)])


def _shingle(utf16: Column, place: Column, shingle: int) -> Column:
    return F.xxhash64(F.substring(utf16, place, F.lit(2 * shingle)))


def signatures(lines: DataFrame, shingle: int = SHINGLE, groups: int = GROUPS, each: int = EACH, batch: int = BATCH) -> DataFrame:
    """k, first_doc, n_lines, clash (several lines have this k), g0, g1, ... (a hash of each group of MinHashes), sketch: one row per different line."""
    chars = lines.select("k", "doc", F.xxhash64(F.lit(7), "line").alias("other"), F.encode("line", "UTF-16BE").alias("utf16"))
    last = _last(F.col("utf16"), shingle)
    rows = chars.select("k", "doc", "other", "utf16", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(2 * batch))).alias("i"))
    # A line is counted at its first row.  The last row repeats the last shingle, which changes no minimum or maximum.
    hashes = [_shingle(F.col("utf16"), F.least(F.col("i") + 2 * t, F.col("last")), shingle).alias(f"h0_{t}") for t in range(batch)]
    rows = rows.select("k", "doc", F.when(F.col("i") == 1, F.col("other")).alias("other"), F.when(F.col("i") == 1, 1).otherwise(0).alias("one"), *hashes)
    # An order goes by 32 bits of a hash; a hash has three orders whose upper 16 bits are different ones.
    for n in range(1, -(-groups * each // 6)):
        rows = rows.select("*", *[F.xxhash64(F.lit(n), f"h0_{t}").alias(f"h{n}_{t}") for t in range(batch)])

    def extreme(j: int) -> Column:
        # The first and the last shingle of an order are two MinHashes.
        order, last = divmod(j, 2)
        n, at = divmod(order, 3)
        values = [F.shiftright(F.shiftleft(f"h{n}_{t}", 16 * at), 32) for t in range(batch)]
        return F.max(F.greatest(*values)) if last else F.min(F.least(*values))

    mins = [extreme(j).alias(f"m{j}") for j in range(groups * each)]
    signed = rows.groupBy("k").agg(F.min("doc").alias("first_doc"), F.sum("one").alias("n_lines"), (F.min("other") != F.max("other")).alias("clash"), *mins)
    fields = [F.shiftleft(F.xxhash64(f"m{j}").bitwiseAND(F.lit(2**FIELD - 1)), FIELD * j) for j in range(min(groups * each, 60 // FIELD))]
    return signed.select("k", "first_doc", "n_lines", "clash", *[F.xxhash64(*[f"m{g * each + e}" for e in range(each)]).alias(f"g{g}") for g in range(groups)], reduce(Column.bitwiseOR, fields).alias("sketch"))


def band_hashes(groups: int = GROUPS) -> Column:
    """Array of the bands of a signed line: one for every two groups, named in the hash, so equal MinHashes of different groups do not meet."""
    return F.array(*[F.xxhash64(F.lit(i), f"g{x}", f"g{y}") for i, (x, y) in enumerate(combinations(range(groups), 2))])


def _close(one: str, other: str) -> Column:
    """Whether two sketches differ in few fields."""
    apart = F.col(one).bitwiseXOR(F.col(other))
    any_bit = reduce(Column.bitwiseOR, [F.shiftrightunsigned(apart, b) for b in range(FIELD)])
    return F.bit_count(any_bit.bitwiseAND(F.lit(sum(1 << (FIELD * j) for j in range(60 // FIELD))))) <= SKETCH_MISSES


def met(signed: DataFrame) -> DataFrame:
    """band, k, n (lines of the bucket) of the lines that share a band."""
    banded = signed.select("k", F.explode(band_hashes()).alias("band"))
    return banded.withColumn("n", F.count("*").over(Window.partitionBy("band"))).where("n > 1").select("band", "k", "n")


def candidates(shared: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs a, b to be tried first: lines of a bucket with its first or with the one before; the two of a bucket of two in any case."""
    rows = shared.join(signed.select("k", "sketch"), "k")
    bucket = Window.partitionBy("band").orderBy("k")
    columns = {"first": F.first("k").over(bucket), "first_sketch": F.first("sketch").over(bucket), "before": F.lag("k").over(bucket), "before_sketch": F.lag("sketch").over(bucket)}
    other = F.when((F.col("n") == 2) | _close("sketch", "first_sketch"), F.col("first")).when(_close("sketch", "before_sketch"), F.col("before"))
    return _pairs(rows.withColumns(columns).where("before is not null").withColumn("other", other).where("other is not null"), "k", "other")


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _still_split(crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """band, k, label of the buckets that hold several components."""
    bucket = Window.partitionBy("band")
    labelled = crowds.join(roots.withColumnRenamed("id", "k"), "k", "left").select("band", "k", F.coalesce("component", "k").alias("label"))
    return labelled.withColumns({"lo": F.min("label").over(bucket), "hi": F.max("label").over(bucket)}).where("lo != hi").select("band", "k", "label")


def _batches(utf16: Column, shingle: int, batch: int) -> Column:
    """Rows that the shingles of a line take, `batch` in each."""
    return F.floor((_last(utf16, shingle) + 2 * batch - 1) / (2 * batch)).cast("int")


def parities(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """k, size (different shingles), p0, p1, ...: bits that say whether the number of shingles that fall on them is odd; wide: the same in more words, for long lines."""
    tasks = 1 + texts.count() // LINES_OF_TASK
    # Dealt out by k once, which all aggregations can use.
    lines = texts.repartition(tasks, "k").select("k", F.encode("line", "UTF-16BE").alias("w"))
    chars = F.octet_length("w") / 2
    n_words = F.when(chars <= NARROW, F.lit(PARITY_WORDS)).otherwise(F.lit(PARITY_WORDS) * F.pow(F.lit(2), F.ceil(F.log2(chars / NARROW)))).cast("int")
    rows = lines.select("k", "w", F.explode(F.sequence(F.lit(0), _batches(F.col("w"), shingle, SET_BATCH) - 1)).alias("i"))
    sets = rows.select("k", n_words.alias("n_words"), _shingles("w", "i", shingle).alias("h")).groupBy("k").agg(F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("h"))).alias("set"))
    # A row for each word of a line, of long lines also those on which no shingle falls; then the words side by side.
    bit, word = F.expr("shiftleft(1L, cast(h & 63 as int))"), F.shiftrightunsigned("h", 6)
    each = sets.select("k", "n_words", F.explode("set").alias("h")).select("k", "n_words", word.bitwiseAND(F.col("n_words") - 1).cast("int").alias("at"), bit.alias("bit"), F.lit(1).alias("one"))
    blank = lines.where(chars > NARROW).select("k", n_words.alias("n_words")).select("k", "n_words", F.explode(F.sequence(F.lit(0), F.col("n_words") - 1)).alias("at"), F.lit(0).cast("long").alias("bit"), F.lit(0).alias("one"))
    bits = each.unionByName(blank).groupBy("k", "n_words", "at").agg(F.bit_xor("bit").alias("bits"), F.sum("one").alias("n"))
    words = [F.bit_xor(F.when(F.col("at").bitwiseAND(F.lit(PARITY_WORDS - 1)) == i, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"p{i}") for i in range(PARITY_WORDS)]
    wide = F.collect_list(F.when(F.col("n_words") > PARITY_WORDS, F.struct("at", "bits")))
    found = bits.groupBy("k").agg(F.sum("n").alias("size"), *words, wide.alias("wide"))
    return found.withColumn("wide", F.when(F.size("wide") > 0, F.array_sort("wide")["bits"]))


_WORDS = [f"p{i}" for i in range(PARITY_WORDS)]
_PARITY = ("size", *_WORDS, "wide")


def _folded(wide: Column, words: Column) -> Column:
    """A wide parity in half as many words, if it has more than `words`."""
    half = F.zip_with(F.slice(wide, F.lit(1), words), F.slice(wide, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(wide) > words, half).otherwise(wide)


def _open(threshold: float) -> Column:
    """Whether the parities of lines a and b leave it open that they resemble each other.

    Every bit that differs is a shingle that one of them lacks; alike lines
    lack (1 - t) / (1 + t) of both sizes at most, and neither has more than 1 / t
    times the other's.  So the parities of lines compared here differ by one
    doubling of their width at most.
    """
    size_a, size_b = F.col("size_a"), F.col("size_b")
    alike = F.least(size_a, size_b) >= F.lit(threshold) * F.greatest(size_a, size_b) - 1e-6
    narrow = reduce(Column.__add__, [F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in _WORDS])
    words = F.least(F.size("wide_a"), F.size("wide_b"))
    xor = F.zip_with(_folded(F.col("wide_a"), words), _folded(F.col("wide_b"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    wide = F.aggregate(xor, F.lit(0), lambda s, x: s + x)
    both = F.col("wide_a").isNotNull() & F.col("wide_b").isNotNull()

    def few(apart: Column) -> Column:
        return F.lit(1 + threshold) * apart <= F.lit(1 - threshold) * (size_a + size_b) + 1e-6

    return alike & few(narrow) & (~both | few(wide))


def left_open(pairs: DataFrame, parity: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs a, b that parities leave open."""
    a, b = (parity.select(*[F.col(c).alias(x if c == "k" else f"{c}_{x}") for c in ("k", *_PARITY)]) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where(_open(threshold)).select("a", "b")


def all_allowed(split: DataFrame, parity: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, sample: bool = False) -> DataFrame:
    """Pairs a, b of a bucket's lines that differ in their component and that parity does not rule out; or one in SAMPLE of them, by a hash.

    A bucket is dealt out in pairs of blocks, so a large one is spread over tasks.
    """
    rows = split.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("band")) / block).cast("int")).join(parity, "k")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("k", F.lit(5)), "blocks").cast("int"))
    columns = ("k", "label", *_PARITY)
    one = rows.select("band", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"), *[F.col(c).alias(f"{c}_a") for c in columns])
    two = rows.select("band", F.explode(F.sequence(F.lit(0), "own")).alias("x"), F.col("own").alias("y"), *[F.col(c).alias(f"{c}_b") for c in columns])
    drawn = F.pmod(F.xxhash64(F.least("k_a", "k_b"), F.greatest("k_a", "k_b")), F.lit(SAMPLE)) == 0 if sample else F.lit(True)
    found = one.join(two, (one["band"] == two["band"]) & (one["x"] == two["x"]) & (one["y"] == two["y"]) & (F.col("label_a") != F.col("label_b")) & ((one["x"] != two["y"]) | (F.col("k_a") < F.col("k_b"))) & drawn & _open(threshold))
    return _pairs(found, "k_a", "k_b")


def similar_lines(texts: DataFrame, pairs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs a, b whose lines have a Jaccard similarity of `threshold` or more; texts: k, line."""
    tasks = 1 + 2 * pairs.count() // LINES_OF_TASK
    # Only lines that some pair names are shuffled.
    named = possible(texts, pairs.select(F.explode(F.array("a", "b")).alias("k")), "k")
    sides = [named.select(F.col("k").alias(x), F.encode("line", "UTF-16BE").alias(f"w{x}")) for x in "ab"]
    # Dealt out by b, as no line is b of many pairs; all that follows stays there.
    both = pairs.join(sides[0], "a").repartition(tasks, "b").join(sides[1], "b").withColumn("n", _batches(F.col("wa"), shingle, SET_BATCH))
    rows = both.select("a", "b", "wa", "wb", "n", F.explode(F.sequence(F.lit(0), F.col("n") + _batches(F.col("wb"), shingle, SET_BATCH) - 1)).alias("i"))
    # Rows up to n are of a, those behind of b.
    of_a = F.col("i") < F.col("n")
    rows = rows.select("a", "b", of_a.alias("of_a"), F.when(of_a, F.col("wa")).otherwise(F.col("wb")).alias("w"), F.when(of_a, F.col("i")).otherwise(F.col("i") - F.col("n")).alias("i"))
    rows = rows.select("a", "b", "of_a", _shingles("w", "i", shingle).alias("h"))
    found = rows.groupBy("a", "b").agg(*[F.flatten(F.collect_list(F.when(of, F.col("h")))).alias(x) for x, of in (("sa", F.col("of_a")), ("sb", ~F.col("of_a")))])
    common, every = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    return found.where(common >= F.lit(threshold) * every - 1e-9).select("a", "b")


def similar_components(lines: DataFrame, signed: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """id, component of the lines that resemble another."""
    shared = cut(met(signed.where("not clash")), ROWS)
    # The lines that share a bucket with another: all that is compared below.
    keys = shared.select("k").distinct()
    texts = possible(lines.select("k", "line"), keys, "k").groupBy("k").agg(F.any_value("line").alias("line"))
    texts = cut(texts.join(keys, "k", "left_semi"))
    parity = cut(parities(texts, shingle), ROWS)
    tried = candidates(shared, signed)
    tried = cut(left_open(tried, parity, threshold), ROWS)
    roots = components(similar_lines(texts, tried, shingle, threshold))
    crowds = shared.where("n > 2").select("band", "k")
    for last in (False, True):
        split = cut(_still_split(crowds, roots), ROWS)
        if split.isEmpty():
            break
        found = all_allowed(split, parity, threshold, sample=not last)
        found = cut(found.join(tried, ["a", "b"], "left_anti"), ROWS)
        links = cut(similar_lines(texts, found, shingle, threshold), ROWS)
        tried = tried.unionByName(found)
        if not links.isEmpty():
            roots = components(roots.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links))
    return roots


def line_dedup(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with their columns, text without the lines that go, and n_lines, n_removed."""
    lines = _lines(docs)
    signed = cut(signatures(lines, shingle), ROWS)
    roots = similar_components(lines, signed, shingle, threshold)
    known = signed.where("not clash").select("k", "first_doc", "n_lines").join(roots.withColumnRenamed("id", "k"), "k", "left").select("k", "first_doc", "n_lines", "component")
    # Lines that occur once and resemble no other need no further look.
    shared = known.where("component is not null or n_lines > 1").withColumn("component", F.coalesce("component", "k"))
    keeper = shared.groupBy("component").agg(F.min("first_doc").alias("keeper"))
    shared = cut(shared.select("k", "component").join(keeper, "component"), ROWS)

    hits = possible(lines.select("doc", "text_key", "pos", "k"), shared, "k").join(shared, "k")
    per_line = hits.groupBy("doc", "text_key", "component", "keeper").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    gone = F.when(F.col("doc") == F.col("keeper"), F.slice("at", 2, F.size("at"))).otherwise(F.col("at"))
    per_doc = per_line.select("doc", "text_key", gone.alias("gone")).groupBy("doc", "text_key").agg(F.flatten(F.collect_list("gone")).alias("gone")).where("size(gone) > 0")

    # The documents travel as one column, so that no column of theirs meets another of its name.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("text_key"))
    joined = keyed.join(per_doc, ["doc", "text_key"], "left").select("row", "gone")
    split = F.split("row.text", "\n")
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    columns = [(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, F.greatest(F.coalesce(F.size(split), F.lit(0)), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
