"""Views of the data model over the synthetic tables.

Each view has its DuckDB twin below, so that every query can be held against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bookmarks; every seventh has no tags (null), every eleventh an empty list."""
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    extra = [F.when(F.coalesce(c, F.lit(0)) == 1, F.array(F.lit(name))).otherwise(F.array().cast("array<string>")) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    tags = F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("array<string>")).when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array("lang", "source"), *extra))
    words = F.split("text", " ")
    return docs.select(
        (F.col("doc_id") % 10).cast("string").alias("user_id"),
        F.col("doc_id").cast("string").alias("bookmark_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat("source", F.lit(".example")).alias("domain"),
        F.array_join(F.slice(words, 1, 8), " ").alias("title"),
        F.col("text").alias("text_content"),
        tags.alias("tags"),
        F.when(F.col("doc_id") % 3 == 0, F.array_join(F.slice(words, 1, 5), " ")).alias("summary"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"),
        "doc_id",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks of the first 200 documents."""
    e = _table(spark, sf_dir, "embeddings")
    doc = F.col("vec_id") % 200
    return e.select(
        F.col("vec_id").cast("string").alias("chunk_id"),
        doc.cast("string").alias("bookmark_id"),
        (doc % 10).cast("string").alias("user_id"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("chunk_text"),
        F.floor(F.col("vec_id") / 200).cast("int").alias("chunk_index"),
        "embedding",
        "vec_id",
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tasks of a queue."""
    e = _table(spark, sf_dir, "events")
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type").isin("signup", "purchase"), "done").otherwise("pending")
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 10, "0").alias("task_id"),
        (F.col("user_id") % 10).cast("string").alias("user_id"),
        F.concat(F.lit("https://"), "event_type", F.lit(".example/"), F.col("event_id").cast("string")).alias("url"),
        status.alias("status"),
        F.array("event_type").alias("tags"),
        ts.alias("created_at"),
        ts.alias("updated_at"),
        (ts + F.expr("INTERVAL 5 MINUTES")).alias("next_delivery"),
        (F.col("event_id") % 6).cast("int").alias("retries"),
        F.lit(None).cast("string").alias("fail_reason"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions, the next assistant turn as the answer; some chunk ids dangle, some repeat."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").dropDuplicates(["conv_id", "turn"])
    q = c.where("role = 'user'").alias("q")
    a = c.where("role = 'assistant'").select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("text").alias("answer"))
    joined = q.join(a, (F.col("q.conv_id") == F.col("c")) & (F.col("q.turn") == F.col("t")), "left")
    ids = F.when(F.col("conv_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(*[x.cast("string") for x in (F.col("conv_id") % 400, (F.col("conv_id") * 7) % 600 + 90_000 * (F.col("conv_id") % 2), F.col("conv_id") % 400)]))
    return joined.select(
        F.concat_ws("-", "conv_id", "turn").alias("session_id"),
        (F.col("conv_id") % 10).cast("string").alias("user_id"),
        F.col("text").alias("question"),
        "answer",
        ids.alias("relevant_chunks"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_at"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages")


#: DuckDB twins of the views, for a WITH clause.
SQL = {
    "bookmarks": """bookmarks AS (
  SELECT CAST(d.doc_id % 10 AS VARCHAR) AS user_id, CAST(d.doc_id AS VARCHAR) AS bookmark_id, 'https://' || source || '.example/' || d.doc_id AS url, source || '.example' AS domain,
    array_to_string(string_split(text, ' ')[1:8], ' ') AS title, text AS text_content,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 11 = 0 THEN CAST([] AS VARCHAR[])
      ELSE list_concat(list_concat([lang, source], CASE WHEN coalesce(quality, 0) = 1 THEN ['good'] ELSE [] END), CASE WHEN coalesce(toxic, 0) = 1 THEN ['toxic'] ELSE [] END) END AS tags,
    CASE WHEN d.doc_id % 3 = 0 THEN array_to_string(string_split(text, ' ')[1:5], ' ') END AS summary, TIMESTAMP '2024-01-01' + to_seconds(d.doc_id * 60) AS created_at, d.doc_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "chunks": """chunks AS (
  SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST(vec_id % 200 AS VARCHAR) AS bookmark_id, CAST(vec_id % 200 % 10 AS VARCHAR) AS user_id, 'chunk ' || vec_id AS chunk_text,
    CAST(vec_id // 200 AS INTEGER) AS chunk_index, CAST(embedding AS DOUBLE[]) AS embedding, vec_id FROM embeddings)""",
    "tasks": """tasks AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS task_id, CAST(user_id % 10 AS VARCHAR) AS user_id, 'https://' || event_type || '.example/' || event_id AS url,
    CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type IN ('signup', 'purchase') THEN 'done' ELSE 'pending' END AS status, [event_type] AS tags,
    date_trunc('second', ts) AS created_at, date_trunc('second', ts) + INTERVAL 5 MINUTE AS next_delivery, CAST(event_id % 6 AS INTEGER) AS retries FROM events)""",
    "sessions": """convs AS (SELECT conv_id, turn, any_value(role) AS role, any_value(text) AS text FROM conversations GROUP BY 1, 2),
sessions AS (
  SELECT q.conv_id || '-' || q.turn AS session_id, CAST(q.conv_id % 10 AS VARCHAR) AS user_id, q.text AS question, a.text AS answer,
    CASE WHEN q.conv_id % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE [CAST(q.conv_id % 400 AS VARCHAR), CAST(q.conv_id * 7 % 600 + 90000 * (q.conv_id % 2) AS VARCHAR), CAST(q.conv_id % 400 AS VARCHAR)] END AS relevant_chunks,
    TIMESTAMP '2024-01-01' + to_seconds(q.conv_id * 3600 + q.turn * 60) AS created_at
  FROM convs q LEFT JOIN convs a ON a.conv_id = q.conv_id AND a.role = 'assistant' AND a.turn = q.turn + 1 WHERE q.role = 'user')""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
