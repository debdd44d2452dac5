"""Queries of the training-data operators, for the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_topk, hard_negatives, lexical_search, line_dedup, media_columns, ngram_jaccard, quality, source_mix, substring_dedup, suffix_dedup, toxicity, url_filters
from .byte_bpe import byte_bpe
from .shared import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, machine).select("doc_id", "held_out", "score", "predicted")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.array_min("slots").alias("first_slot"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(table(spark, sf_dir, "pages"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns.media_columns(table(spark, sf_dir, "documents"))
    return out.drop("media")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors, network = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, vectors, network).select("doc_id", "held_out", "score", "predicted")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.drop("ids")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("removed_to", "removed_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed_from").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_toxicity, op3_source_mix, op4_substring_dedup, op5_line_dedup, op6_url_filters, op7_media_columns, op8_quality, op9_exact_topk, op10_byte_bpe, op11_suffix_dedup, op12_lexical_search, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": ngram_jaccard.ORACLE, "op3_source_mix": source_mix.ORACLE, "op4_substring_dedup": substring_dedup.ORACLE, "op6_url_filters": url_filters.ORACLE, "op9_exact_topk": exact_topk.ORACLE, "op11_suffix_dedup": suffix_dedup.ORACLE, "op12_lexical_search": lexical_search.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
