"""Hybrid retrieval and what happens to its matches: fusion, merging, token budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, MAX_CHUNKS, THRESHOLD, MAX_TOKENS, RESERVED_TOKENS = 60, 6, 0.3, 4096, 200


def ranked(df: DataFrame, name: str, *order: Column | str, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


#: Levels of a score for each doubling, and the one of all that is not above 0.
LEVELS, LOWEST_LEVEL = 256, -(1 << 31)


def score_level(score: Column | str) -> Column:
    """A whole number that never falls as a score rises; all that is not above 0 shares the lowest."""
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score > 0, F.floor(F.log2(score) * LEVELS)).otherwise(F.lit(LOWEST_LEVEL))


def hybrid(vector_matches: DataFrame, text_hits: DataFrame, limit: int) -> DataFrame:
    """vector_matches: bookmark_id, chunk_id, similarity, at most `limit`; text_hits: bookmark_id, rank of a full-text search.

    text_hits holds a bookmark once.  Adds vector_rank, fts_score and fts_rank.  A chunk without a hit gets score
    0 and rank limit + 1, which is better than the rank of a late hit.
    """
    best = ranked(vector_matches.orderBy(F.desc("similarity"), "chunk_id").limit(limit), "vector_rank", F.desc("similarity"), "chunk_id")
    # All uses below read one and the same exchange, so the search runs once.  Its columns are never null and met by
    # inner joins only, as what the optimizer infers for nulls and semi joins would go below it and make it another.
    key = F.coalesce(F.concat(F.lit("="), "bookmark_id"), F.lit(""))
    hits = text_hits.select(key.alias("key"), F.coalesce("rank", F.lit(0.0)).alias("fts_score")).repartition("key")
    hits = hits.withColumn("level", F.coalesce(score_level("fts_score"), F.lit(LOWEST_LEVEL)))
    wanted = best.select(F.concat(F.lit("="), "bookmark_id").alias("b")).distinct()
    matched = hits.join(F.broadcast(wanted), F.col("key") == F.col("b"))  # `limit` rows at most
    # The rank of a hit counts all hits before it: those of higher levels by a histogram, those of its own level one by one.
    levels = hits.groupBy("level").agg(F.count("*").alias("n"))
    above = levels.withColumn("above", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # LEVELS rows for each doubling of the score
    probe = F.broadcast(matched.select("b", F.col("fts_score").alias("s"), "level"))  # `limit` rows
    before = (F.col("fts_score") > F.col("s")) | ((F.col("fts_score") == F.col("s")) & (F.col("key") != "") & (F.col("key") < F.col("b")))
    beside = hits.join(probe, "level").groupBy("b", F.col("s").alias("fts_score"), "level").agg(F.count_if(before).alias("beside"))
    order = beside.join(above, "level").select(F.substring("b", 2, 1 << 30).alias("bookmark_id"), "fts_score", (F.col("above") + F.col("beside") + 1).cast("int").alias("fts_rank"))
    joined = best.join(order, "bookmark_id", "left")
    return joined.withColumns({"fts_score": F.coalesce("fts_score", F.lit(0.0)), "fts_rank": F.coalesce("fts_rank", F.lit(limit + 1))})


def rrf(k: int = RRF_K) -> Column:
    return 1.0 / (k + F.col("vector_rank")) + 1.0 / (k + F.col("fts_rank"))


def weighted(vector_weight: float = 0.5, text_weight: float = 0.5) -> Column:
    check_weights(vector_weight, text_weight)
    total = vector_weight + text_weight
    return F.col("similarity") * (vector_weight / total) + F.col("fts_score") * (text_weight / total)


def check_weights(vector_weight: float, text_weight: float) -> None:
    if not all(math.isfinite(w) and w >= 0 for w in (vector_weight, text_weight)) or vector_weight + text_weight == 0:
        raise ValueError("weights must be finite, not negative, and not both 0")


def merge_matches(matches: DataFrame, most: int = MAX_CHUNKS, mode: str = "adjacent", keys: tuple[str, ...] = ()) -> DataFrame:
    """matches: chunk_id, similarity, qpos, pos.  The best `most` of all question variants, ranked from 1.

    `adjacent` drops a chunk only where it follows itself in the order; a chunk
    that two variants score differently may stay twice.  `global` keeps the best
    row of each chunk.
    """
    order = (F.desc("similarity"), F.col("qpos"), F.col("pos"))
    if mode == "global":
        kept = ranked(matches, "_n", *order, keys=(*keys, "chunk_id")).where("_n = 1").drop("_n")
    elif mode == "adjacent":
        before = F.lag("chunk_id").over(Window.partitionBy(*keys).orderBy(*order))
        kept = matches.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("chunk_id"))).drop("_before")
    else:
        raise ValueError(f"unknown mode: {mode}")
    return ranked(kept, "rank", *order, keys=keys).where(F.col("rank") <= most)


def within_budget(matches: DataFrame, max_tokens: int = MAX_TOKENS, tokens: str = "tokens", order: tuple = ("rank",), keys: tuple[str, ...] = ()) -> DataFrame:
    """The longest run of first matches whose tokens fit; the first that does not fit ends it."""
    room = max(0, max_tokens - RESERVED_TOKENS)
    running = F.sum(tokens).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return matches.withColumn("running_tokens", running).where(F.col("running_tokens") <= room)


def word_tokens(text: Column | str) -> Column:
    """Default token counter: words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def byte_tokens(text: Column | str) -> Column:
    """Fallback counter: a quarter of the bytes."""
    return F.floor(F.octet_length(text) / 4).cast("int")
