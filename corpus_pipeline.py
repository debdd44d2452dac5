"""The corpus pipeline: five stages from raw documents to token ids.

1. toxicity: documents that the factorization machine rejects go.
2. lines: repeated and nearly repeated lines go, one of each component stays.
3. near_duplicates: of each group of similar documents the smallest id stays.
4. mix: sources are mixed to their target weights; what a document is taken
   for more than once repeats it, what is taken in part cuts it.  Rows are in
   the order of the schedule, so a stretch of them is mixed like the whole.
5. tokens: every remaining text is encoded and decoded.

Each stage reads all that its predecessor kept.  A model keeps to its own
stage: the machine is fitted on the labelled rows of the `labels` table.
Rows without doc_id pass the near-duplicate stage as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_dedup, ngram_jaccard, source_mix, toxicity
from quarry.llm.byte_bpe import byte_bpe
from quarry.llm.shared import cut, table, words_column

RANKS = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, machine).where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines."""
    kept = line_dedup.line_dedup(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each component that has the smallest id."""
    found = ngram_jaccard.ngram_jaccard(docs)
    spare = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(spare, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole copies, then the words of a last part, in the order of the schedule's slots."""
    plan = source_mix.mix_sources(docs).where("taken > 0")
    # Rows that share doc_id, source and size are the same to the schedule; what it takes of them is dealt in order.
    keys = ["doc_id", "source", "size"]
    plan = plan.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("taken", "slots"))).alias("takes"))
    # The documents travel as one column, so that no column of theirs meets another of its name.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("d"), F.col("source").cast("string").alias("s"), source_mix.word_count("text").alias("n"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size"))
    joined = keyed.join(plan, same).select("row", "d", "s", "n", "takes")
    # Only rows that repeat an id need a number among their equals.
    alone = joined.where("size(takes) = 1").withColumn("take", F.element_at("takes", 1))
    number = F.row_number().over(source_mix.Window.partitionBy("d", "s", "n").orderBy("row.text"))
    repeated = joined.where("size(takes) > 1").withColumn("take", F.get("takes", number - 1)).where("take is not null")
    taken = alone.unionByName(repeated)
    # A copy is a number of words, the last one what is left, and stands at the slot of its pass.
    copies = F.expr("transform(sequence(0L, (take.taken - 1) div n), i -> struct(least(n, take.taken - i * n) as words, get(take.slots, cast(least(i, size(take.slots) - 1) as int)) as slot))")
    rows = taken.select("row", "n", "d", F.explode(copies).alias("copy"))
    part = F.array_join(F.slice(words_column("row.text"), F.lit(1), F.col("copy.words").cast("int")), " ")
    text = F.when(F.col("copy.words") == F.col("n"), F.col("row.text")).otherwise(part)
    rows = rows.withColumn("text", text).repartitionByRange("copy.slot", "d").sortWithinPartitions("copy.slot", "d")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the decoded bytes."""
    return byte_bpe(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix),
    ("tokens", encode),
]

#: A learned score and banded similarity have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
