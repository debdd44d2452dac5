"""Token windows of texts, their hashes, and whether stored results still fit them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Windows of one batch.
WINDOW_ROWS = 1024


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 2000
    overlap: int = 200

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError("size must be positive and overlap below it")

    @classmethod
    def of(cls, provider: str) -> ChunkConfig:
        """Local models get shorter texts."""
        return cls(1000, 100) if provider == "ollama" else cls()


def word_list(text: Column | str) -> Column:
    """Default tokenizer: words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def windows(df: DataFrame, config: ChunkConfig, text: str = "text_content", keep_partial: bool = True) -> DataFrame:
    """chunk_index and chunk_text of each window of a row's tokens.

    A text without tokens has no window, one shorter than a window is one.  A
    last window that is not full stays unless keep_partial is false; it may lie
    wholly inside the one before.
    """
    step = config.size - config.overlap
    tokens = df.withColumn("_t", word_list(text))
    last = F.col("n") - 1 if keep_partial else F.greatest(F.col("n") - config.size, F.lit(0))
    starts = tokens.withColumn("n", F.size("_t")).where("n > 0").withColumn("_s", F.sequence(F.lit(0), last, F.lit(step)))
    rows = starts.select(*df.columns, "_t", F.posexplode("_s").alias("chunk_index", "_at"))
    return rows.withColumn("chunk_text", F.array_join(F.slice("_t", F.col("_at") + 1, F.lit(config.size)), " ")).drop("_t", "_at")


def token_windows(df: DataFrame, config: ChunkConfig, encode: Callable[[str], Sequence[int]], decode: Callable[[list[int]], str], text: str = "text_content") -> DataFrame:
    """Like windows, over the ids of a codec: a text is encoded, its ids are cut, every window is decoded.

    The codec travels with the tasks; windows leave them in batches of WINDOW_ROWS.
    """
    step, kept = config.size - config.overlap, [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(kept))
            row, index, texts = [], [], []

            def flushed(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                at = pa.array(row, pa.int64())
                columns = [batch.column(i).take(at) for i in range(len(kept))]
                return pa.RecordBatch.from_arrays([*columns, pa.array(index, pa.int32()), pa.array(texts, pa.string())], names=[*kept, "chunk_index", "chunk_text"])

            for at in range(batch.num_rows):
                ids = list(encode(value)) if (value := values[at].as_py()) else []
                for n, begin in enumerate(range(0, len(ids), step)):
                    row.append(at)
                    index.append(n)
                    texts.append(decode(ids[begin : begin + config.size]))
                    if len(row) == WINDOW_ROWS:
                        yield flushed()
                        row, index, texts = [], [], []
            yield flushed()

    fields = [df.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_text", T.StringType())])
    return df.select(*kept, text).mapInArrow(run, schema)


def chunks_of(chunks: DataFrame, user_id: str, bookmark_id: str) -> DataFrame:
    """The chunks of one bookmark of a tenant, in order."""
    return chunks.where((F.col("user_id") == user_id) & (F.col("bookmark_id") == bookmark_id)).orderBy("chunk_index")


def with_hash(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_hash", F.sha2("chunk_text", 256))


def cache_validity(fresh: DataFrame, stored: DataFrame, version: int, keys: tuple[str, ...] = ("user_id", "bookmark_id")) -> DataFrame:
    """valid per key: the stored chunks have the same indexes, hashes and version as the fresh ones; otherwise all are computed anew."""
    new = fresh.select(*keys, "chunk_index", F.col("chunk_hash").alias("new_hash"))
    old = stored.select(*keys, "chunk_index", F.col("chunk_hash").alias("old_hash"), "pipeline_version")
    both = new.join(old, [*keys, "chunk_index"], "full_outer")
    same = F.coalesce((F.col("new_hash") == F.col("old_hash")) & (F.col("pipeline_version") == version), F.lit(False))
    return both.groupBy(*keys).agg(F.bool_and(same).alias("valid"))
