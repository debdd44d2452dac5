"""Sinks: pages, images as rows of bytes, index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("bookmark_id"), F.lit(buckets)).cast("int")


def write_pages(pages: DataFrame, path: str, buckets: int = 64) -> None:
    """user_id, bookmark_id and the html as it is, compressed, in a folder per tenant and hash bucket: few files, and one page is read from one of them."""
    rows = pages.select("user_id", "bookmark_id", "html", _bucket(buckets).alias("bucket")).repartition("user_id", "bucket")
    rows.sortWithinPartitions("user_id", "bucket", "bookmark_id").write.mode("append").partitionBy("user_id", "bucket").option("compression", "zstd").parquet(path)


def stored_page(spark: SparkSession, path: str, user_id: str, bookmark_id: str, buckets: int = 64) -> DataFrame:
    """The stored html of one bookmark; the filters reach folders and row groups."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(bookmark_id)), F.lit(buckets)).cast("int").alias("b")).first()["b"]
    found = spark.read.schema("bookmark_id string, html string, user_id string, bucket int").parquet(path)
    return found.where((F.col("user_id") == user_id) & (F.col("bucket") == bucket) & (F.col("bookmark_id") == bookmark_id)).select("user_id", "bookmark_id", "html")


def write_images(images: DataFrame, path: str, present: DataFrame | None = None) -> None:
    """Images that `present` (image_id) does not have yet."""
    new = images if present is None else images.join(present.select("image_id"), "image_id", "left_anti")
    new.dropDuplicates(["image_id"]).write.mode("append").parquet(path)


def write_postings(postings: DataFrame, table: str, buckets: int) -> None:
    """The index, bucketed and sorted by lexeme: a query reads the buckets of its terms."""
    postings.write.mode("overwrite").bucketBy(buckets, "lexeme").sortBy("lexeme").saveAsTable(table)
