"""Sources: URL lists, browser exports, pages and images; fetchers are injected."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from ..functions.urls import bookmark_id, canonical_url


class MalformedLine(ValueError):
    pass


def url_lines(spark: SparkSession, path: str) -> DataFrame:
    """url: the lines of text files that are not blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url != ''")


def check_urls(urls: DataFrame) -> DataFrame:
    """The same rows; an error if one is no URL with a host."""
    bad = urls.where(canonical_url("url").isNull()).orderBy("url").first()
    if bad:
        raise MalformedLine(bad["url"])
    return urls


def not_imported(urls: DataFrame, done: DataFrame) -> DataFrame:
    """What an append-only list of imported URLs does not name yet."""
    return urls.join(done.select("url").distinct(), "url", "left_anti")


def browser_export(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """url, title of the bookmarks directly inside a folder of an exported bookmark file.

    Subfolders are skipped, and so are script and query bookmarks.  The file is
    one row; its lines nest by the DL tags before them, which a running sum
    over the lines counts.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "(?i)(?=<DT>)|(?=</?DL)")).alias("pos", "part"))
    opens = F.when(F.lower("part").startswith("<dl"), 1).when(F.lower("part").startswith("</dl"), -1).otherwise(0)
    w = Window.partitionBy("file").orderBy("pos")
    nested = raw.withColumn("depth", F.sum(opens).over(w))
    head = F.trim(F.regexp_extract("part", r"(?is)<H3[^>]*>(.*?)</H3>", 1))
    # A heading names the list that opens next, one level below it.
    named = nested.withColumn("start", F.when(head == folder, F.col("depth") + 1))
    named = named.withColumn("level", F.last("start", ignorenulls=True).over(w)).withColumn("group", F.count("start").over(w))
    # The list ends where the depth falls below its level.
    ended = F.max(F.when((F.col("depth") < F.col("level")) & F.lower("part").startswith("</dl"), 1).otherwise(0)).over(Window.partitionBy("file", "group").orderBy("pos"))
    inside = named.withColumn("ended", ended).where((F.col("group") == 1) & (F.col("depth") == F.col("level")) & (F.col("ended") == 0))
    url = F.regexp_extract("part", r"(?is)^<DT>\s*<A\b[^>]*?HREF=\"([^\"]*)\"", 1)
    name = F.trim(F.regexp_extract("part", r"(?is)<A\b[^>]*>(.*?)</A>", 1))
    found = inside.select(url.alias("url"), H.unescaped(name).alias("title"), "pos").where("url != ''")
    return found.where(~F.lower("url").rlike("^(javascript|place):")).orderBy("pos").select("url", "title")


def images(pages: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys, src, image_url, image_id of each image of a page that has an address."""
    found = pages.select(*keys, "url", F.explode(H.image_sources("html")).alias("src"))
    found = found.withColumn("image_url", canonical_url(H.absolute(F.col("src"), F.col("url")))).where("image_url is not null")
    return found.select(*keys, "src", "image_url").distinct().withColumn("image_id", bookmark_id("image_url"))


def fetched(images: DataFrame, fetch: Callable[[str], tuple[bytes, str | None]], url: str = "image_url") -> DataFrame:
    """Adds content and content_type; what cannot be fetched is left out, as a page does without it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for address in batch[url]:
                try:
                    content, kind = fetch(address)
                    got.append((content, kind or "application/octet-stream"))
                except Exception:
                    got.append((None, None))
            yield batch.assign(content=[g[0] for g in got], content_type=[g[1] for g in got])

    schema = T.StructType([*images.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("content_type", T.StringType())])
    return images.mapInPandas(run, schema).where("content is not null")


_CHARSET = re.compile(r"""(?i)charset\s*=\s*["']?([^\s"';>]+)""")


def _decoded(content: bytes, kind: str | None) -> str:
    """The text of a page: by the charset its answer or its head names, else as UTF-8; what is broken is replaced."""
    named = _CHARSET.search(kind or "") or _CHARSET.search(content[:1024].decode("latin-1"))
    try:
        return content.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


def fetched_pages(urls: DataFrame, fetch: Callable[[str], tuple[bytes, str | None]], url: str = "url") -> DataFrame:
    """The rows whose address `fetch` can read, with the html of their pages."""

    def decoded(contents: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.array([_decoded(c, k) for c, k in zip(contents.to_pylist(), kinds.to_pylist(), strict=True)], pa.string())

    return fetched(urls, fetch, url).withColumn("html", F.arrow_udf(decoded, "string")("content", "content_type")).drop("content", "content_type")


def rewritten_images(pages: DataFrame, images: DataFrame, prefix: str = "/static", key: str = "page_id") -> DataFrame:
    """html with the sources of known images pointing to their stored copies; unknown ones stay."""
    lists = images.groupBy(key).agg(F.collect_list(F.struct("src", "image_id")).alias("found"))
    joined = pages.join(lists, key, "left")
    none = F.array().cast("array<struct<src:string,image_id:string>>")
    found = F.coalesce("found", none)
    targets = F.transform(found, lambda x: F.concat(F.lit(f"{prefix}/"), F.col(key).cast("string"), F.lit("/"), x["image_id"]))
    return joined.withColumn("html", H.with_image_sources("html", found["src"], targets)).drop("found")
