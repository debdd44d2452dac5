"""Small helpers that several operators use."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of the session are held to 8 MB where nobody has set their size, as each task holds a few of them."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) == "67108864b":  # the default
        conf.set(key, "8m")
    return df


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow; when a task ends, its worker gives back what it no longer uses.

    Spark keeps workers for later tasks and stages, whose memory theirs would add to.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share; a temporary one only in a local session (tests) where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoint-")
    return folder


def cut(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder.

    With `rows_per_task`, what has few rows comes back in few partitions (but
    not fewer than the cluster's cores), so that shuffles of it write few files.
    Rows are counted as they are written, without a job of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    if rows_per_task is None:
        return df.checkpoint(eager=True)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
    return out.coalesce(max(context.defaultParallelism, -(-seen.get["rows"] // rows_per_task)))


class Stored:
    """A table written to the shared folder, compressed, for jobs that read it several times."""

    def __init__(self, df: DataFrame) -> None:
        self.path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.table = df.sparkSession.read.schema(df.schema).parquet(self.path)

    def clear(self) -> None:
        """Gives the space back, when nothing will read the table any more."""
        self.table.sparkSession.createDataFrame([], self.table.schema).coalesce(1).write.mode("overwrite").parquet(self.path)


#: Bits of the map in `possible`, in words of 64: at most 262,144 rows of two numbers, whatever the corpus.
MAP_BITS = 1 << 24


def possible(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key, a long, may be among `keys`, without a shuffle of the rows.

    A bit per hashed key says so; false hits must fall out of a join that
    follows.  With so many keys that the map fills up, all rows pass.
    """
    place = F.pmod(F.xxhash64(key), F.lit(MAP_BITS)).cast("int")
    words = keys.select(place.alias("_at")).select(F.shiftright("_at", 6).alias("_word"), F.expr("shiftleft(1L, _at & 63)").alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    # MAP_BITS / 64 rows at most, whatever the number of keys.
    marked = df.withColumn("_at", place).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(words), "_word")
    return marked.where(F.expr("(shiftrightunsigned(_bits, _at & 63) & 1L) = 1L")).select(*df.columns)


def marked(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """The rows with a boolean `flag`, without a shuffle: false where their key, a long, is not among `keys` for sure.

    A bit per hashed key says so; false hits must fall out of a join that
    follows.  With so many keys that the map fills up, all rows are marked.
    """
    place = F.pmod(F.xxhash64(key), F.lit(MAP_BITS)).cast("int")
    words = keys.select(F.pmod(F.xxhash64(F.col(key)), F.lit(MAP_BITS)).cast("int").alias("_at")).select(F.shiftright("_at", 6).alias("_word"), F.expr("shiftleft(1L, _at & 63)").alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    # MAP_BITS / 64 rows at most, whatever the number of keys.
    found = df.withColumn("_at", place).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(words), "_word", "left")
    return found.withColumn(flag, F.expr("coalesce((shiftrightunsigned(_bits, _at & 63) & 1L) = 1L, false)")).drop("_at", "_word", "_bits")


def words_column(text: str = "text"):
    """Array of the words of a text; null has none."""
    return F.expr(f"regexp_extract_all(coalesce({text}, ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")


def word_count(text: str = "text"):
    """Number of words of a text as long; null has 0."""
    return F.expr(f"cast(regexp_count(coalesce({text}, ''), '[^\\\\x20\\\\x09-\\\\x0D]+') as long)")
