"""Approximate nearest vectors: cells of two levels, residuals as short codes, exact scores at the end.

1. Centroids come from a bounded sample of unit vectors: some groups first,
   then the cells of each group, fitted in parallel.
2. What a vector differs by from its cell's centroid is cut into parts, and each
   part is replaced by the nearest of 256 code words, also fitted from the
   sample.  The index keeps a vector's key, cell and code, a byte per part.
3. A batch of queries is joined to the index on the cells nearest to each.  A
   table of each part's products with all code words scores a cell's vectors
   by lookups.  The best `candidates` of a query get their exact similarity.

The model is a few megabytes at any number of vectors (cells and code words
times dimensions) and is what is broadcast.  New vectors are assigned by the
same model and appended.  A cell that holds more than `part_rows` vectors is
dealt out in parts, and its queries in blocks of at most `most`, so no task
holds a whole hot cell, all queries or all their candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vector import MOST_QUERIES, best_of, by_key, cosine, matrix, norm, unit

#: Sampled vectors per cell, and at most; steps of a fit; code words of a part.
PER_CELL, SAMPLE, STEPS, WORDS = 40, 200_000, 12, 256
#: Vectors of a cell that one task scores.
PART_ROWS = 100_000
#: Candidates that a block of queries makes in one task; rows of a batch that leaves `probes`.
MOST_FOUND, PROBE_ROWS = 500_000, 10_000


def clusters(points: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Centroids of at most k clusters; those that lose all their points move to the points that fit worst."""
    different = np.unique(points, axis=0)
    if len(different) <= k:
        return different
    rng = np.random.default_rng(seed)
    centers = different[rng.choice(len(different), k, replace=False)]
    for _ in range(STEPS):
        distance = (centers**2).sum(1) - 2 * points @ centers.T
        own = distance.argmin(1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            worst = np.argsort(-(distance[np.arange(len(points)), own] + (points**2).sum(1)), kind="stable")
            centers[empty] = points[worst[: len(empty)]]
    return centers


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * points @ centers.T).argmin(1)


@dataclass(frozen=True)
class VectorIndex:
    """groups [g, d]; first cell of each group and the end; cells [c, d]; words [parts, up to 256, d / parts]."""

    groups: np.ndarray
    first: np.ndarray
    cells: np.ndarray
    words: tuple[np.ndarray, ...]

    @classmethod
    def fit(cls, chunks: DataFrame, cells: int, parts: int, seed: int = 1, sample: int = SAMPLE) -> VectorIndex:
        """From at most PER_CELL different vectors for each cell and `sample` in all, taken in the order of a hash of the vectors."""
        usable = chunks.where(norm("embedding") > 0).select(unit("embedding").alias("u")).withColumn("h", F.xxhash64("u"))
        # Copies of a vector count once, or a few with many copies would be all of the sample.
        least = usable.select("h").distinct().orderBy("h").limit(min(sample, PER_CELL * cells))
        drawn = usable.join(least, "h", "left_semi").dropDuplicates(["h"]).orderBy("h").select("u").toArrow()
        if not drawn.num_rows:
            raise ValueError("no vectors to fit")
        points = matrix(drawn.column("u"))
        spark, n_groups = chunks.sparkSession, max(1, round(cells**0.5))
        groups = clusters(points, n_groups, seed)
        own = _nearest(points, groups)
        of = lambda name, keys, rows: spark.createDataFrame(pa.table({name: pa.array(keys, pa.int32()), "u": pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))}))

        def fitted(name: str, keys: np.ndarray, rows: np.ndarray, k: dict[int, int]) -> dict[int, np.ndarray]:
            """Clusters of the rows of each key, one task for each."""

            def run(group: pa.Table) -> pa.Table:
                key = group.column(name)[0].as_py()
                centers = clusters(matrix(group.column("u")), k[key], seed)
                return pa.table({name: pa.array([key] * len(centers), pa.int32()), "c": pa.array(centers.tolist(), pa.list_(pa.float64()))})

            found = of(name, keys, rows).groupBy(name).applyInArrow(run, f"{name} int, c array<double>").toArrow()
            at = found.column(name).to_numpy()
            return {key: matrix(found.column("c").take(pa.array(np.flatnonzero(at == key)))) for key in np.unique(at).tolist()}

        # Each group has cells by its share of the sample.
        shares = {g: max(1, round(cells * n / len(own))) for g, n in enumerate(np.bincount(own, minlength=len(groups)).tolist()) if n}
        per_group = fitted("g", own, points, shares)
        kept = sorted(per_group)
        table = np.concatenate([per_group[g] for g in kept])
        first = np.cumsum([0, *(len(per_group[g]) for g in kept)])
        model = cls(groups[kept], first, table, ())
        width = points.shape[1] // parts
        if width * parts != points.shape[1]:
            raise ValueError("parts must divide the dimensions")
        rest = (points - table[model.cell_of(points)]).reshape(len(points), parts, width)
        words = fitted("p", np.tile(np.arange(parts), len(points)), rest.reshape(-1, width), dict.fromkeys(range(parts), WORDS))
        return cls(groups[kept], first, table, tuple(words[p] for p in range(parts)))

    def cell_of(self, points: np.ndarray, tried: int = 2) -> np.ndarray:
        """The nearest cell of the `tried` nearest groups."""
        near = np.argsort((self.groups**2).sum(1) - 2 * points @ self.groups.T, axis=1, kind="stable")[:, :tried]
        best, cell = np.full(len(points), np.inf), np.zeros(len(points), np.int64)
        for g in np.unique(near).tolist():
            rows = np.flatnonzero((near == g).any(axis=1))
            centers = self.cells[self.first[g] : self.first[g + 1]]
            distance = (centers**2).sum(1) - 2 * points[rows] @ centers.T
            at = distance.argmin(1)
            found = distance[np.arange(len(rows)), at]
            better = found < best[rows]
            best[rows[better]], cell[rows[better]] = found[better], at[better] + self.first[g]
        return cell

    def code(self, points: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = (points - self.cells[cell]).reshape(len(points), len(self.words), -1)
        return np.stack([_nearest(rest[:, p], w) for p, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def assigned(self, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
        """key, cell, code of every chunk with a vector that is not zero: the rows of the index, also for chunks that come later."""
        model = chunks.sparkSession.sparkContext.broadcast(self)  # a model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    points = matrix(batch.column(1))
                    cell = model.value.cell_of(points)
                    codes = model.value.code(points, cell)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=[key, "cell", "code"])

        rows = chunks.where((F.size("embedding") == self.cells.shape[1]) & (norm("embedding") > 0)).select(key, unit("embedding").alias("u"))
        return rows.mapInArrow(run, f"{key} {chunks.schema[key].dataType.simpleString()}, cell int, code binary")

    def probes(self, queries: DataFrame, n: int) -> DataFrame:
        """query_id, u (unit vector) and cell of the n cells most similar to each query."""
        model = queries.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = max(1, PROBE_ROWS // n)
            for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
                if batch.num_rows:
                    points, m = matrix(batch.column(1)), model.value
                    near = np.argsort((m.cells**2).sum(1) - 2 * points @ m.cells.T, axis=1, kind="stable")[:, :n]
                    at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel(), pa.int32())], names=["query_id", "u", "cell"])

        rows = queries.where((F.size("query") == self.cells.shape[1]) & (norm("query") > 0)).select("query_id", unit("query").alias("u"))
        return rows.mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, u array<double>, cell int")

    def nearest_batch(self, index: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, probes: int, candidates: int | None = None, key: str = "chunk_id", part_rows: int = PART_ROWS, most: int = MOST_QUERIES) -> DataFrame:
        """queries: query_id, query.  Up to k chunks of each with exact similarity and rank, from its `probes` cells.

        index is read once for the whole batch; the exact similarities of
        `candidates` (10 * k) chunks a query come from one join with chunks.
        """
        wanted = candidates or 10 * k
        most = max(1, min(most, MOST_FOUND // wanted))
        model = index.sparkSession.sparkContext.broadcast(self)
        near = self.probes(queries, probes)
        blocks = near.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
        sizes = F.broadcast(index.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")).join(blocks, "cell"))  # a row per cell
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda name, n: F.pmod(F.xxhash64(name), n).cast("int")
        rows = index.join(sizes, "cell").select("cell", own(key, "parts").alias("part"), each("blocks").alias("block"), key, "code")
        asked = near.join(sizes, "cell").select("cell", each("parts").alias("part"), own("query_id", "blocks").alias("block"), "query_id", "u")

        def run(cell_rows: pa.Table, cell_queries: pa.Table) -> pa.Table:
            at_query, at_row, scores = [], [], []
            if cell_rows.num_rows and cell_queries.num_rows:
                m = model.value
                cell = cell_rows.column("cell")[0].as_py()
                cell_rows = cell_rows.take(pa.array(by_key(cell_rows.column(key))))  # ties go by key
                codes = np.frombuffer(b"".join(cell_rows.column("code").to_pylist()), np.uint8).reshape(cell_rows.num_rows, -1).T.copy()
                for i, query in enumerate(matrix(cell_queries.column("u"))):
                    score = np.full(cell_rows.num_rows, query @ m.cells[cell])
                    for p, (words, part) in enumerate(zip(m.words, query.reshape(len(m.words), -1), strict=True)):
                        score += (words @ part)[codes[p]]
                    best = best_of(score, wanted)
                    at_query.append(np.full(len(best), i))
                    at_row.append(best)
                    scores.append(score[best])
            joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            return pa.table([cell_queries.column("query_id").take(pa.array(joined(at_query, np.int64))), cell_rows.column(key).take(pa.array(joined(at_row, np.int64))), pa.array(joined(scores, np.float64))], names=["query_id", key, "score"])

        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {chunks.schema[key].dataType.simpleString()}, score double"
        found = rows.groupBy("cell", "part", "block").cogroup(asked.groupBy("cell", "part", "block")).applyInArrow(run, kinds)
        likely = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))).where(F.col("place") <= wanted).select("query_id", key)
        exact = likely.join(queries.select("query_id", "query"), "query_id").join(chunks.select(key, "embedding"), key)
        exact = exact.select("query_id", key, cosine("embedding", "query").alias("similarity"))
        best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
        return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
