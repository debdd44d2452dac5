"""Sessions: asked first, answered later, with the chunks they cite."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def opened(questions: DataFrame, now: datetime) -> DataFrame:
    """questions: session_id, user_id, question.  Sessions that wait for an answer: it is null, no chunk is cited."""
    values = {"answer": F.lit(None).cast("string"), "relevant_chunks": F.array().cast("array<string>"), "created_at": F.lit(now), "updated_at": F.lit(now)}
    return questions.select("session_id", "user_id", "question").withColumns(values)


def answered(sessions: DataFrame, answers: DataFrame, now: datetime) -> DataFrame:
    """answers: session_id, user_id, answer, relevant_chunks; one of another tenant, or of no session, has no effect."""
    new = answers.select("session_id", "user_id", F.col("answer").alias("_answer"), F.col("relevant_chunks").alias("_chunks"), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    values = {"answer": F.when(hit, F.col("_answer")).otherwise(F.col("answer")), "relevant_chunks": F.when(hit, F.col("_chunks")).otherwise(F.col("relevant_chunks")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}
    return sessions.join(new, ["session_id", "user_id"], "left").withColumns(values).select(*sessions.columns)


def with_sources(sessions: DataFrame, chunks: DataFrame, columns: tuple[str, ...] = ("chunk_id", "bookmark_id", "chunk_index")) -> DataFrame:
    """Adds sources: one struct per cited chunk in the order of citation; unknown ids fall out, repeated ones stay, no citation gives an empty list."""
    cited = sessions.select("session_id", F.posexplode("relevant_chunks").alias("pos", "chunk_id"))
    found = cited.join(chunks.select(*columns), "chunk_id")
    lists = found.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("found"))
    joined = sessions.join(lists, "session_id", "left")
    plain = F.transform("found", lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    empty = F.array().cast(chunks.select(F.array(F.struct(*columns)).alias("x")).schema["x"].dataType)
    return joined.withColumn("sources", F.coalesce(plain, empty)).drop("found")


def cited_ids(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.explode("relevant_chunks").alias("chunk_id")).distinct()
