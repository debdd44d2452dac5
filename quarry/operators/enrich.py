"""Enrichment of saved texts by models that are plain callables run inside tasks."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import ChunkConfig, cache_validity, windows, with_hash
from .tags import normalized

#: Dimensions of the vectors of known models.
DIMENSIONS = {
    ("openai", "text-embedding-3-large"): 3072,
    ("openai", "text-embedding-3-small"): 1536,
    ("openai", "text-embedding-ada-002"): 1536,
    ("gemini", "gemini-embedding-001"): 3072,
    ("gemini", "text-embedding-004"): 768,
    ("ollama", "all-minilm"): 384,
    ("ollama", "nomic-embed-text"): 768,
}
#: What the messages of errors that pass contain, in lower case.
PASSING = ("429", "too many requests", "timed out", "timeout", "connection reset", "temporarily unavailable", "server error")
TOO_MANY_REQUESTS, SERVER_ERROR = 429, 500
#: Further wordings of clients: limits, and the status of a server out of order.
ALSO_PASSING = re.compile(r"(?i)rate.?limit|\b50[0234]\b")
RETRIES, BASE_MS, MOST_MS = 2, 1000, 30_000
KEYS = ["user_id", "bookmark_id"]


def dimensions(provider: str, model: str, embed: Callable[[str], Sequence[float]], configured: int | None = None) -> int:
    """The configured number, else that of a known model, else that of a probe."""
    return configured or DIMENSIONS.get((provider, model)) or len(embed("a text of no matter"))


def _causes(error: BaseException | None) -> Iterator[BaseException]:
    """The error and what it came from."""
    while error is not None:
        yield error
        error = error.__cause__ or error.__context__


def retriable(error: Exception) -> bool:
    """Whether the same call may succeed later: by the kind or the `status` of the error or of a cause, or by what its message says."""
    for cause in _causes(error):
        status = getattr(cause, "status", None)
        if isinstance(cause, (TimeoutError, ConnectionError)) or isinstance(status, int) and (status == TOO_MANY_REQUESTS or status >= SERVER_ERROR):
            return True
    message = str(error).lower()
    return any(part in message for part in PASSING) or ALSO_PASSING.search(message) is not None


def wait_ms(attempt: int, rng: random.Random, base: int = BASE_MS, most: int = MOST_MS) -> float:
    """Evenly spread between the base and its double for each attempt, `most` at most."""
    return rng.uniform(base, max(base, min(base * 2**attempt, most)))


def with_retries(call: Callable, *args, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep, seed: int = 0):
    rng = random.Random(seed)
    for attempt in range(1, retries + 2):
        try:
            return call(*args)
        except Exception as error:
            if attempt > retries or not retriable(error):
                raise
            sleep(wait_ms(attempt, rng) / 1000)


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[Sequence[float]]], batch: int = 64) -> DataFrame:
    """user_id, bookmark_id, chunk_index, chunk_text with their embedding; the model gets `batch` texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, vectors = rows["chunk_text"].tolist(), []
            for at in range(0, len(texts), batch):
                part = with_retries(embed, texts[at : at + batch])
                if len(part) != len(texts[at : at + batch]):
                    raise ValueError(f"{len(part)} embeddings for {len(texts[at : at + batch])} texts")
                vectors += [[float(x) for x in v] for v in part]
            yield rows.assign(embedding=vectors)

    return chunks.select(*KEYS, "chunk_index", "chunk_text").mapInPandas(run, "user_id string, bookmark_id string, chunk_index int, chunk_text string, embedding array<float>")


def chunk_rows(bookmarks: DataFrame, config: ChunkConfig) -> DataFrame:
    """Hashed windows of the texts."""
    return with_hash(windows(bookmarks.select(*KEYS, "text_content"), config))


def analyzed(fresh: DataFrame, stored: DataFrame, analyze: Callable[[str], tuple[str, Sequence[str]]], version: int) -> DataFrame:
    """Summary and tags of every chunk: stored rows where they are valid for the whole bookmark, else from the model."""
    validity = cache_validity(fresh, stored, version)
    reused = stored.join(validity.where("valid"), KEYS, "left_semi")
    todo = fresh.join(validity.where("valid"), KEYS, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [with_retries(analyze, text) for text in rows["chunk_text"]]
            yield rows.drop(columns="chunk_text").assign(pipeline_version=version, summary=[s for s, _ in found], tags=[list(t) for _, t in found])

    schema = "user_id string, bookmark_id string, chunk_index int, chunk_hash string, pipeline_version int, summary string, tags array<string>"
    made = todo.select(*KEYS, "chunk_index", "chunk_hash", "chunk_text").mapInPandas(run, schema)
    return reused.select(*made.columns).unionByName(made)


def consolidated(chunks: DataFrame) -> DataFrame:
    """Per bookmark: the chunk summaries in order, a line each, and the sorted distinct tags; input of the last model call."""
    parts = chunks.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "summary"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    lines = F.array_join(F.transform(F.filter("s", lambda x: x["summary"].isNotNull()), lambda x: x["summary"]), "\n")
    return parts.select(*KEYS, lines.alias("summaries"), normalized("tags").alias("tags"))
