"""Hard negatives of anchors, scored by the method of the Four Russians.

Vectors become integers, so that scores are exact.  Candidates of a block are
turned into bit planes in two's complement: for every plane and every group of
eight dimensions a candidate has one byte.  For an anchor the sums of all 256
subsets of its eight components in a group are tabled once; a candidate's score
is then one lookup per byte, added over the groups and shifted by the plane,
the last plane counting negative.  That is the full inner product.

Blocks of candidates and blocks of anchors meet once in each of two passes: the
first scores the rows of an anchor's own label and keeps its best positives,
the second the rows of other labels and keeps, for each positive, the best
whose score lies between `low` and `high` hundredths of the positive's.  The
two passes together score a pair once.  Only the best of a block leave it, and
windows with a limit before the shuffle merge those of all blocks.

Defined results: rows without vec_id, label or vector, or with a null or
non-finite component take no part; vectors are compared with those of their own
length only; rows that share an anchor's vec_id are neither its positives nor
its negatives; an anchor whose vec_id repeats counts once, with the smallest of
its labels and then vectors, while candidate rows that repeat count each; ties
go to the smaller vec_id; a positive whose score is not above 0 has no
negatives but those of score 0, if it is 0; an empty table gives an empty
result; other columns are ignored.  Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import block_rows, by_length, finite

POSITIVES, NEGATIVES, LOW, HIGH, ANCHOR_EVERY, SCALE = 5, 10, 30, 90, 100, 256
#: Rows of a block of candidates or anchors at most; a small table is still cut into blocks of LEAST, up to SPREAD of them, to keep all cores busy.
BLOCK, LEAST, SPREAD = 16_384, 1024, 64
_PAIRS = "anchor_id long, place int, other_id long, score long, positive_id long, positive_score long"
_NAMES = [x.split()[0] for x in _PAIRS.split(", ")]


class BitPlanes:
    """Vectors as bytes: bit j of the byte of plane b and group g is bit b of component 8 * g + j."""

    def __init__(self, vectors: np.ndarray) -> None:
        n, dims = vectors.shape
        self.groups = -(-dims // 8)
        padded = np.zeros((n, self.groups * 8), np.int64)
        padded[:, :dims] = vectors
        low, high = int(padded.min(initial=0)), int(padded.max(initial=0))
        self.n = n
        # The last plane is the sign.
        self.count = 1 + max(high.bit_length(), (-1 - low).bit_length())
        self.bytes = [np.ascontiguousarray(np.packbits(((padded >> b) & 1).astype(np.uint8), axis=1, bitorder="little").T) for b in range(self.count)]

    def scores(self, tables: np.ndarray, rows: slice) -> np.ndarray:
        """Inner product of the tabled anchor with each of the rows."""
        total = np.zeros(len(range(*rows.indices(self.n))), np.int64)
        for b, plane in enumerate(self.bytes):
            part = np.zeros_like(total)
            for g in range(self.groups):
                part += tables[g][plane[g, rows]]
            total = total + (part << b) if b < self.count - 1 else total - (part << b)
        return total


def subset_sums(vector: np.ndarray) -> np.ndarray:
    """For each group of eight components, the sums of all its subsets; bit j of the place says whether component j is in."""
    padded = np.zeros(-(-len(vector) // 8) * 8, np.int64)
    padded[: len(vector)] = vector
    parts = padded.reshape(-1, 8)
    sums = np.zeros((len(parts), 1), np.int64)
    for j in range(8):
        sums = np.concatenate([sums, sums + parts[:, j : j + 1]], axis=1)
    return sums


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, best first, ties by id."""
    keep = np.arange(len(scores))
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _meet(candidates: pa.Table, anchors: pa.Table) -> Iterator[tuple]:
    """For each anchor: its row, tables, the planes of the candidates of its length, their ids, and the slice that has its label."""
    a_labels = anchors.column("label").to_numpy()
    c_ids, c_labels = candidates.column("vec_id").to_numpy(), candidates.column("label").to_numpy()
    of_length = {wide.shape[1]: (rows, wide) for rows, wide in by_length(anchors.column("v"), np.int64)}
    for rows, vectors in by_length(candidates.column("v"), np.int64):
        if vectors.shape[1] not in of_length:
            continue
        order = np.argsort(c_labels[rows], kind="stable")
        labels, ids, planes = c_labels[rows][order], c_ids[rows][order], BitPlanes(vectors[order])
        for row, vector in zip(*of_length[vectors.shape[1]], strict=True):
            low, high = np.searchsorted(labels, [a_labels[row]], "left")[0], np.searchsorted(labels, [a_labels[row]], "right")[0]
            yield row, subset_sums(vector), planes, ids, int(low), int(high)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], pa.int32() if n == "place" else pa.int64()) for i, n in enumerate(_NAMES)], names=_NAMES)


def _positives(candidates: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    rows = []
    if candidates.num_rows and anchors.num_rows:
        anchor_ids = anchors.column("vec_id").to_numpy()
        for row, tables, planes, ids, low, high in _meet(candidates, anchors):
            own, scores = ids[low:high], planes.scores(tables, slice(low, high))
            others = np.flatnonzero(own != anchor_ids[row])
            best = others[_best(scores[others], own[others], k)]
            rows += [(int(anchor_ids[row]), 0, i, s, None, None) for i, s in zip(own[best].tolist(), scores[best].tolist(), strict=True)]
    return _table(rows)


def _negatives(candidates: pa.Table, anchors: pa.Table, k: int, low_share: int, high_share: int) -> pa.Table:
    rows = []
    if candidates.num_rows and anchors.num_rows:
        anchor_ids = anchors.column("vec_id").to_numpy()
        positives = anchors.column("positives").to_pylist()  # a handful each
        for row, tables, planes, ids, low, high in _meet(candidates, anchors):
            others = np.concatenate([ids[:low], ids[high:]])
            scores = np.concatenate([planes.scores(tables, slice(0, low)), planes.scores(tables, slice(high, planes.n))])
            allowed = others != anchor_ids[row]
            for place, positive in enumerate(positives[row]):
                # In whole numbers of Python, so that no product overflows.
                floor, top = -(-low_share * positive["score"] // 100), high_share * positive["score"] // 100
                inside = np.flatnonzero(allowed & (scores >= floor) & (scores <= top))
                best = inside[_best(scores[inside], others[inside], k)]
                rows += [(int(anchor_ids[row]), place, i, s, positive["id"], positive["score"]) for i, s in zip(others[best].tolist(), scores[best].tolist(), strict=True)]
    return _table(rows)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_every: int = ANCHOR_EVERY, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """vectors: vec_id, label, embedding.  anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by anchor_every; every block
    of them meets every block of candidates, so work grows with anchors times
    rows, as exact mining does, and a task's memory with `block` alone.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("e")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("e"))
    usable = usable.select("vec_id", "label", F.transform("e", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    size = usable.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims")).first()
    rows = block_rows(block, size["dims"])
    n_cand = max(1, -(-size["n"] // rows), min(SPREAD, size["n"] // LEAST))
    n_anchor = max(1, -(-size["n"] // (anchor_every * rows)))
    hashed = F.xxhash64("vec_id", F.lit(11))
    cand = usable.withColumn("c", F.pmod(hashed, F.lit(n_cand)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_anchor - 1))))
    anchors = usable.where(F.pmod("vec_id", F.lit(anchor_every)) == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")

    def met(side: DataFrame, run) -> DataFrame:
        spread = side.withColumn("q", F.pmod(hashed, F.lit(n_anchor)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))))
        # New names for the columns, as the second pass reads what comes from the first.
        fresh = cand.select(*[F.col(c).alias(c) for c in cand.columns])
        return fresh.groupBy("c", "q").cogroup(spread.groupBy("c", "q")).applyInArrow(run, _PAIRS)

    def first(found: DataFrame, k: int, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best = first(met(anchors, lambda a, b: _positives(a, b, positives)), positives, "anchor_id")
    best = best.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("other_id").alias("id"), "score"))), lambda x: x.dropFields("rank")).alias("positives"))
    paired = anchors.join(best.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = first(met(paired, lambda a, b: _negatives(a, b, negatives, low, high)), negatives, "anchor_id", "place")
    return found.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = r"""
WITH u AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, r.label AS label, r.v AS v FROM (SELECT vec_id, min({'label': label, 'v': v}) AS r FROM u WHERE vec_id % 100 = 0 GROUP BY vec_id)),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, u.vec_id, u.label, u.rid, CAST(coalesce(list_dot_product(a.v, u.v), 0) AS BIGINT) AS score
  FROM a JOIN u ON len(a.v) = len(u.v) AND u.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE label = anchor_label) WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
