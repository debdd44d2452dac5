"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors are turned into integers, so that scores are exact.  The table is cut
into blocks of candidates and of queries; every pair of blocks meets once.  A
block of candidates keeps, for each dimension, its vectors sorted by that
component.  For a query the lists are read from the end that raises the score,
all to the same depth; every vector met is scored in full, and reading stops
once the threshold (the best score that an unseen vector could reach) is below
the query's kth score so far.  The best k of all blocks merge in a window.

Defined results: ties go to the smaller vec_id; a query is never its own
candidate (rows that repeat its vec_id are not candidates of it either); a
candidate row that repeats another counts again, a query whose vec_id repeats
once, with the smallest of its vectors; vectors are compared with those of their
own length only; vectors that are null or empty, or that hold null or non-finite
components take no part; with fewer than
k candidates all are returned; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import block_rows, by_length, finite

K, QUERY_EVERY, SCALE = 10, 100, 1024
#: Vectors whose components are sorted together; of the candidates and of the queries that meet in one task.
BLOCK, TASK_BLOCK, QUERY_BLOCK = 4096, 16_384, 16_384


class SortedLists:
    """The vectors of a block, sorted by each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        # By id, so that of equal scores the first met in a stable sort is the smaller id.
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.rows = np.argsort(self.vectors, axis=0, kind="stable")  # ascending, a column per dimension
        self.values = np.take_along_axis(self.vectors, self.rows, axis=0)

    def search(self, query: np.ndarray, own_id: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Up to k (vec_id, score), best first; candidates that score below `floor` may be missing."""
        n, dims = self.vectors.shape
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        seen = np.zeros(n, bool)
        up = query > 0
        used = np.flatnonzero(query)
        depth, step = 0, max(k, n // 16)
        while True:
            # Threshold at this depth: what a vector not met so far could score at most.
            if depth < n:
                edge = np.where(up, self.values[n - 1 - depth], self.values[depth])
                bound = float(edge[used] @ query[used]) if len(used) else 0.0
            else:
                return best_ids, best
            kth = max(floor, best[k - 1]) if len(best) >= k else floor
            if bound < kth or (len(best) >= k and bound == best[k - 1] and seen.all()):
                return best_ids, best
            end = min(n, depth + step)
            met = np.concatenate([self.rows[n - end : n - depth, used[up[used]]].ravel(), self.rows[depth:end, used[~up[used]]].ravel()]) if len(used) else np.arange(n)
            fresh = np.zeros(n, bool)
            fresh[met] = True
            fresh &= ~seen
            seen |= fresh
            rows = np.flatnonzero(fresh & (self.ids != own_id))
            ids, scores = np.concatenate([best_ids, self.ids[rows]]), np.concatenate([best, self.vectors[rows] @ query])
            order = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[order], scores[order]
            depth, step = (end if len(used) else n), 2 * step


def _search(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out: list[list[np.ndarray]] = [[], [], []]
    if candidates.num_rows and queries.num_rows:
        cand_ids, query_ids = candidates.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        asked = {wanted.shape[1]: (rows, wanted) for rows, wanted in by_length(queries.column("v"), np.float64)}
        for at, cand in by_length(candidates.column("v"), np.float64):
            if cand.shape[1] not in asked:
                continue
            lists = [SortedLists(cand_ids[at[a : a + BLOCK]], cand[a : a + BLOCK]) for a in range(0, len(at), BLOCK)]
            for row, query in zip(*asked[cand.shape[1]], strict=True):
                best, floor = (np.zeros(0, np.int64), np.zeros(0)), -np.inf
                for block in lists:
                    ids, scores = (np.concatenate(x) for x in zip(best, block.search(query, int(query_ids[row]), k, floor), strict=True))
                    order = np.lexsort((ids, -scores))[:k]
                    best = ids[order], scores[order]
                    floor = best[1][-1] if len(order) == k else floor
                for column, values in zip(out, (np.full(len(best[0]), query_ids[row]), *best), strict=True):
                    column.append(values.astype(np.int64))
    return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out], names=["query_id", "vec_id", "score"])


def exact_topk(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each vector whose id is divisible by query_every.

    Block counts follow from a count of the table; a task never holds more than some 16,000 candidates and as many queries, fewer where vectors are long, at any size.
    A candidate is sent once for every block of queries.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).where(F.col("vec_id").isNotNull() & finite("e") & (F.size("e") > 0))
    usable = usable.select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    size = usable.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims")).first()
    n_cand = max(1, -(-size["n"] // block_rows(TASK_BLOCK, size["dims"])))
    n_query = max(1, -(-size["n"] // (query_every * block_rows(QUERY_BLOCK, size["dims"]))))
    hashed = F.xxhash64("vec_id", F.lit(7))
    cand = usable.withColumn("c", F.pmod(hashed, F.lit(n_cand)).cast("int"))
    cand = cand.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    query = usable.where(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("q", F.pmod(hashed, F.lit(n_query)).cast("int"))
    query = query.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))))
    pairs = cand.groupBy("c", "q").cogroup(query.groupBy("c", "q")).applyInArrow(lambda a, b: _search(a, b, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM u WHERE vec_id % 100 = 0 GROUP BY vec_id) q JOIN u c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
