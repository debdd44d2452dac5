"""Cosine retrieval, exact and by an approximate index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block, which every block of chunks meets in one task.
MOST_QUERIES = 4096
#: Chunks of a block.
BLOCK_ROWS = 8192


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null for a zero vector or for different lengths, so such rows drop out of every threshold."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def nearest(chunks: DataFrame, query: Sequence[float], k: int, threshold: float | None = None, key: str = "chunk_id") -> DataFrame:
    """The k chunks most similar to one vector, with similarity; only k rows leave a task."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.withColumn("similarity", cosine("embedding", vector)).where("similarity is not null")
    if threshold is not None:
        scored = scored.where(F.col("similarity") >= threshold)
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as an array, from the column's buffers."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def by_key(column: pa.ChunkedArray) -> np.ndarray:
    """Rows in Spark's ascending order of a key."""
    return pc.sort_indices(column, null_placement="at_start").to_numpy().astype(np.int64)


def best_of(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; of those that tie for the last places, the first."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])


def _scored(chunks: pa.Table, queries: pa.Table, k: int, threshold: float | None, key: str) -> pa.Table:
    """The best k of a block of chunks for each of a block of queries; both of one length."""
    at_query, at_chunk, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if chunks.num_rows and queries.num_rows:
        order = by_key(chunks.column(key))
        vectors, wanted = matrix(chunks.column("v"))[order], matrix(queries.column("v"))
        norms, lengths = np.sqrt((vectors**2).sum(1)), np.sqrt((wanted**2).sum(1))
        for i, query in enumerate(wanted):
            if lengths[i] == 0:
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                score = vectors @ query / (norms * lengths[i])
            good = np.flatnonzero(norms > 0) if threshold is None else np.flatnonzero((norms > 0) & (score >= threshold))
            good = good[best_of(score[good], k)]
            at_query.append(np.full(len(good), i))
            at_chunk.append(order[good])
            found.append(score[good])
    take = lambda t, c, at: t.column(c).take(pa.array(np.concatenate(at)))
    return pa.table([take(queries, "query_id", at_query), take(chunks, key, at_chunk), pa.array(np.concatenate(found))], names=["query_id", key, "similarity"])


def nearest_batch(chunks: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, key: str = "chunk_id", most: int = MOST_QUERIES) -> DataFrame:
    """queries: query_id, query.  Up to k chunks of each, with similarity and rank.

    One scan of the chunks, dealt into blocks that each meet every block of
    queries; vectors meet those of their own length.  Only keys, vectors and
    scores take part, only the best of a block leave its task, and the other
    columns join the k of each query at the end.
    """
    usable = chunks.where("embedding is not null").select(key, F.col("embedding").cast("array<double>").alias("v")).where("size(v) > 0")
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("v")).where("size(v) > 0")
    n_chunks, n_queries = max(1, -(-usable.count() // BLOCK_ROWS)), max(1, -(-asked.count() // most))
    left = usable.withColumns({"_c": F.pmod(F.xxhash64(key), F.lit(n_chunks)).cast("int"), "_d": F.size("v")}).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    right = asked.withColumns({"_q": F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).cast("int"), "_d": F.size("v")}).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {chunks.schema[key].dataType.simpleString()}, similarity double"
    by = ("_c", "_q", "_d")
    scored = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: _scored(a, b, k, threshold, key), kinds)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # New names for the columns, as both sides come from the chunks.
    return chunks.select(*[F.col(c).alias(c) for c in chunks.columns]).join(ranked, key)


@dataclass(frozen=True)
class InvertedLists:
    """Approximate index: cells around centroids, of which a query reads the nearest few.

    The centroids come from a bounded sample; every vector is then put into the
    cell of its nearest centroid.  Written partitioned by cell, the table lets a
    query prune all other cells.
    """

    centroids: tuple[tuple[float, ...], ...]

    @classmethod
    def fit(cls, chunks: DataFrame, cells: int, sample: int = 50_000, seed: int = 1) -> InvertedLists:
        """k-means over unit vectors of at most `sample` rows, taken in the order of a hash of the vectors."""
        usable = chunks.where("embedding is not null").select(unit("embedding").alias("u")).where("u is not null")
        drawn = usable.orderBy(F.xxhash64("u")).limit(sample).select(array_to_vector("u").alias("features"))
        model = KMeans(k=cells, seed=seed, maxIter=10).fit(drawn)
        return cls(tuple(tuple(float(x) for x in c) for c in model.clusterCenters()))

    def _by_similarity(self, vector: Column) -> Column:
        """Cells, the most similar centroid first; for as many cells as a plan holds as literals."""
        table = F.array(*[F.array(*map(F.lit, c)) for c in self.centroids])
        scored = F.transform(table, lambda c, i: F.struct((-F.coalesce(cosine(vector, c), F.lit(-2.0))).alias("d"), i.alias("cell")))
        return F.transform(F.array_sort(scored), lambda x: x["cell"])

    def assigned(self, chunks: DataFrame) -> DataFrame:
        """The chunks with their cell; rows without a vector have none and drop out of searches."""
        return chunks.withColumn("cell", F.when(F.col("embedding").isNotNull(), F.get(self._by_similarity(F.col("embedding")), F.lit(0))))

    def nearest(self, index: DataFrame, query: Sequence[float], k: int, probes: int, threshold: float | None = None, key: str = "chunk_id") -> DataFrame:
        """Like `nearest`, among the `probes` cells nearest to the query."""
        ranked = index.sparkSession.range(1).select(self._by_similarity(F.array(*[F.lit(float(x)) for x in query])).alias("cells")).first()["cells"]
        return nearest(index.where(F.col("cell").isin(ranked[:probes])), query, k, threshold, key)


def unit(vector: str) -> Column:
    """Null for a zero vector.  The norm is an argument of the function over the components, and so is not taken for each of them."""
    return F.element_at(F.transform(F.array(norm(vector)), lambda n: F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n))), 1)


def check_dimensions(chunks: DataFrame, n_texts: int | None = None) -> int:
    """The one dimension of all vectors; an error if there are several, or fewer vectors than texts."""
    row = chunks.agg(F.count("embedding").alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    if n_texts is not None and row["n"] != n_texts:
        raise ValueError(f"{n_texts} chunks but {row['n']} embeddings")
    if row["lo"] != row["hi"]:
        raise ValueError(f"embeddings of {row['lo']} to {row['hi']} dimensions")
    return row["lo"] or 0


def profile_change(stored: tuple | None, current: tuple, has_chunks: bool) -> str:
    """keep, store or reset: what a changed embedding profile (provider, model, dimensions) asks for."""
    if stored == current:
        return "keep"
    return "reset" if stored is not None or has_chunks else "store"
