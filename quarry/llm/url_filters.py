"""URL filters by hashed host-suffix and path-prefix expressions (native).

Every distinct URL is expanded into the expressions `host suffix + path prefix`
that a rule could name: the suffixes of the host that have as many labels as
some rule's host, times the prefixes of the path that have the length of some
rule's path, so an URL of whatever length has few.  An
expression meets the rules in an equi-join on the first bytes of its SHA-256
digest; the full digest then confirms the hit, and the longest rule wins.

Rules are met once for each distinct URL.  The pages of one URL, however many,
then meet its one verdict row in a left join, whose large partitions adaptive
execution splits (spark.sql.adaptive.skewJoin.enabled, on by default).

Defined results: a null URL or one without ``://`` has an empty host and path
and meets no rule; a URL that no rule fits gets `default` as its verdict;
repeated rows are all kept; other columns of the table are ignored; of two
rules with the same host and path the blocking one wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Hexadecimal digits of a digest on which expressions and rules are joined.
PREFIX_DIGITS = 8


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(authority, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": host, "path": path})


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", id_column: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""
    spark = pages.sparkSession
    pages = url_parts(pages.select(id_column, url), url)
    # The rules are a parameter of the call, so a local relation; Spark sizes it and picks the join.
    rows = [(v, h + p, len(h + p)) for v, h, p in rules]
    table = spark.createDataFrame(rows, "rule_verdict string, rule string, weight int")
    table = table.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    lengths = sorted({len(p) for _, _, p in rules}) or [0]

    depths = sorted({h.count(".") + 1 for _, h, _ in rules}) or [1]
    dots = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit("")))
    urls = pages.where(F.col("host") != "").select("host", "path").distinct()
    deep = urls.select("host", "path", F.explode(F.array(*map(F.lit, depths))).alias("depth")).where(dots >= F.col("depth") - 1)
    suffixes = deep.select("host", "path", F.expr("substring_index(host, '.', -depth)").alias("suffix"))
    expressions = suffixes.select("host", "path", "suffix", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    expressions = expressions.where(F.length("path") >= F.col("n")).withColumn("digest", F.sha2(F.expr("concat(suffix, substring(path, 1, n))"), 256))
    expressions = expressions.select("host", "path", F.col("digest").alias("own_digest"), F.substring("digest", 1, PREFIX_DIGITS).alias("short"))
    hits = expressions.join(table, "short").where(F.col("own_digest") == F.col("digest"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct("weight", F.col("rule_verdict").alias("v"), "rule")).alias("best"))
    # Pages without a host meet no rule; a salt keeps them from meeting in one task.
    salt = F.when(F.col("host") == "", F.xxhash64(id_column)).otherwise(F.lit(0).cast("long"))
    found = pages.withColumn("_salt", salt).join(best.withColumn("_salt", F.lit(0).cast("long")), ["host", "path", "_salt"], "left")
    return found.select(id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path,
  (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
FROM split
"""
