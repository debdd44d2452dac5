"""Question answering over chunks, with models as plain callables.

Retrieval, merging, filtering and the budget are Spark plans; a model sees the
question on the driver, or chunk texts in tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fts, fusion, vector

#: Fixed values.
NO_ANSWER = "I couldn't find any relevant information in your bookmarks to answer this question."
UNASSESSED = "Could not assess relevance"


@dataclass(frozen=True)
class Hybrid:
    enabled: bool = False
    use_rrf: bool = True
    rrf_k: int = fusion.RRF_K
    vector_weight: float = 0.5
    text_weight: float = 0.5

    def check(self) -> None:
        if self.enabled and not self.use_rrf:
            fusion.check_weights(self.vector_weight, self.text_weight)


@dataclass
class RagEngine:
    """embed: text to vector; expand: question to more questions; relevant: (question, text) to (keep, why); answer: (question, texts) to text."""

    embed: Callable[[str], Sequence[float]]
    expand: Callable[[str], Sequence[str]] = lambda question: ()
    relevant: Callable[[str, str], tuple[bool, str]] | None = None
    answer: Callable[[str, list[str]], str] = lambda question, texts: "\n\n".join(texts)
    tokens: Callable[[Column], Column] = fusion.word_tokens
    max_chunks: int = fusion.MAX_CHUNKS
    threshold: float = fusion.THRESHOLD
    max_tokens: int = fusion.MAX_TOKENS
    hybrid: Hybrid = Hybrid()

    def questions(self, question: str) -> list[str]:
        """The question, then its variants; without variants if the model fails."""
        try:
            return [question, *self.expand(question)]
        except Exception:
            return [question]

    def _matches(self, bookmarks: DataFrame, chunks: DataFrame, question: str, qpos: int) -> DataFrame:
        limit = 2 * self.max_chunks
        found = vector.nearest(chunks, self.embed(question), limit, self.threshold)
        found = found.select("chunk_id", "bookmark_id", "chunk_index", "chunk_text", "similarity")
        if self.hybrid.enabled:
            hits = fts.search(fts.search_columns(bookmarks), fts.web_query(question))
            found = fusion.hybrid(found, hits.select("bookmark_id", "rank"), limit)
            score = fusion.rrf(self.hybrid.rrf_k) if self.hybrid.use_rrf else fusion.weighted(self.hybrid.vector_weight, self.hybrid.text_weight)
            found = found.withColumn("similarity", score).drop("vector_rank", "fts_score", "fts_rank")
        found = fusion.ranked(found, "pos", F.desc("similarity"), "chunk_id")
        return found.withColumn("qpos", F.lit(qpos))

    def retrieve(self, bookmarks: DataFrame, chunks: DataFrame, user_id: str, question: str) -> DataFrame:
        """The chunks that go into the prompt, ranked."""
        self.hybrid.check()
        mine = F.col("user_id") == user_id
        parts = [self._matches(bookmarks.where(mine), chunks.where(mine), q, i) for i, q in enumerate(self.questions(question))]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        merged = fusion.merge_matches(found, self.max_chunks)
        if self.relevant is not None:
            merged = self._filtered(merged, question)
        merged = merged.withColumn("tokens", self.tokens(F.col("chunk_text")))
        return fusion.within_budget(merged, self.max_tokens)

    def _filtered(self, merged: DataFrame, question: str) -> DataFrame:
        judge = self.relevant

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                verdicts = []
                for text in batch["chunk_text"]:
                    try:
                        verdicts.append(judge(question, text))
                    except Exception:
                        verdicts.append((True, UNASSESSED))  # a chunk that could not be judged stays
                yield batch.assign(keep=[bool(v[0]) for v in verdicts], why=[v[1] for v in verdicts])

        schema = T.StructType([*merged.schema.fields, T.StructField("keep", T.BooleanType()), T.StructField("why", T.StringType())])
        return merged.mapInPandas(run, schema).where("keep").drop("keep")

    def ask(self, bookmarks: DataFrame, chunks: DataFrame, user_id: str, question: str, now: datetime) -> dict:
        """The session row: question, answer and cited chunk ids; at most max_chunks rows come to the driver."""
        cited = self.retrieve(bookmarks, chunks, user_id, question).orderBy("rank").select("chunk_id", "chunk_text").collect()
        text = self.answer(question, [c["chunk_text"] for c in cited]) if cited else NO_ANSWER
        return {"session_id": str(uuid.uuid5(uuid.NAMESPACE_OID, f"{user_id} {now} {question}")), "user_id": user_id, "question": question, "answer": text, "relevant_chunks": [c["chunk_id"] for c in cited], "created_at": now}
