"""Mixing sources to target weights by a low-discrepancy schedule of equal-word blocks (native).

1. Every source gets a target number of words: its share by weight of all
   words, at most `limit` times its size, the excess being shared again by
   weight.  The targets are the level of a water-filling over the sources
   sorted by the level at which they are full, which running sums give.
2. The documents of a source, shuffled by a hash, form a stream of words that
   is cut into blocks of equal length.
3. Slot i of the schedule is the point frac(i * golden ratio); the cumulative
   numbers of slots that the sources need, and some more for each, map it to a
   source.  Slots are ranked within their source, and rank r takes block r
   modulo the number of blocks, for the (r div n_blocks)-th time.  The slot
   that reaches the target is cut there.
4. A document is placed where the schedule first takes it in each pass over its
   source.  Written in the order of these slots, every long enough stretch of
   the mix, not only the whole, holds the sources by their targets.

Running sums never sort in one task: a table is dealt out by ranges, the
ranges' sums are added up, and the rest is summed inside each.

Defined results: a null or empty text has size 0 and takes nothing; null is a
source of its own, the last one; rows that repeat a doc_id are mixed each for
itself; the order of the shuffle depends on doc_id, source and size alone, so
reruns agree; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, word_count

WEIGHTS, LIMIT = (1, 2, 3), 3
#: Words of a block; fewer where the corpus has under BLOCKS_PER_SOURCE blocks of that size for each source.
BLOCK_WORDS, BLOCKS_PER_SOURCE = 64, 256
#: Rows of one running window: documents of a hash range, slots of a chunk.
RANGE_ROWS, CHUNK = 20_000, 1 << 16
#: The golden ratio, and the fraction of CHUNK times it.
GOLDEN, CHUNK_STEP = 0.6180339887498949, 0.4754867131087195
#: Slots of a source beyond those it needs: more than the golden-ratio points of an interval ever fall short of its share.
SPARE = 32


def _sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column | str]) -> DataFrame:
    """Adds, under each name, the sum of a column over all rows that come earlier in the order, which must be total."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    per = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_{n}") for n, v in sums.items()])
    # A row per range, of which there are as many as shuffle partitions at most.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(base), "_range")
    return out.withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in sums.items()}).drop("_range", *[f"_{n}" for n in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """sizes: source, source_size.  source, sid (from 0), source_size, target and total."""
    s = _sums_before(sizes, [F.asc_nulls_last("source")], {"sid": F.lit(1)}).withColumn("sid", F.col("sid").cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1))
    s = s.withColumn("cap", F.lit(float(limit)) * F.col("source_size")).withColumn("full", F.col("cap") / F.col("weight"))
    s = cut(_sums_before(s, [F.asc("full"), F.asc("sid")], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}))
    all_of = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    # The level is that of the first source, in the order of levels, which it does not overfill.
    s = s.withColumn("level", (F.lit(float(all_of["total"])) - F.col("cap_before")) / (F.lit(all_of["weight"]) - F.col("weight_before")))
    level = s.where("level <= full").agg(F.min_by("level", F.struct("full", "sid"))).first()[0] or 0.0
    return s.select("source", "sid", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"), F.lit(all_of["total"]).cast("long").alias("total"))


def slots_needed(targets: DataFrame, block: int) -> DataFrame:
    """Adds goal (words), n_blocks, slots, all_slots and the interval [low, high) of the schedule, wide enough for all slots of the source."""
    s = targets.withColumns({"goal": F.round("target").cast("long"), "n_blocks": F.expr(f"(source_size + {block - 1}) div {block}")})
    # Whole passes over the blocks, the last of which may be short, and the blocks that the rest begins.
    passes = F.expr(f"(goal div source_size) * n_blocks + (goal % source_size + {block - 1}) div {block}")
    s = s.withColumn("slots", F.when((F.col("source_size") > 0) & (F.col("goal") > 0), passes + SPARE).otherwise(F.lit(0).cast("long")))
    s = cut(_sums_before(s, [F.asc("sid")], {"slots_before": F.col("slots")}))
    n = s.agg(F.sum("slots")).first()[0] or 0
    share = lambda c: F.col(c).cast("double") / F.lit(float(n)) if n else F.lit(0.0)
    s = s.withColumn("slots_after", F.col("slots_before") + F.col("slots"))
    return s.withColumns({"low": share("slots_before"), "high": share("slots_after"), "all_slots": F.lit(n).cast("long")}).drop("slots_before", "slots_after")


def _running(df: DataFrame, keys: list[str], within: str, value: Column | str, order: list[Column | str]) -> Column:
    """Sum of `value` over the earlier rows of (keys, within)."""
    window = Window.partitionBy(*keys, within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def schedule(targets: DataFrame, n_slots: int, n_sources: int) -> DataFrame:
    """slot, sid and rank of each slot within its source."""
    spark = targets.sparkSession
    cells = max(1024, n_sources)
    # A chunk's first point is made apart, so that points stay exact enough for narrow intervals however many slots there are.
    point = F.expr(f"(id div {CHUNK}) * {CHUNK_STEP}D + (id % {CHUNK} + 1) * {GOLDEN}D")
    slots = spark.range(0, n_slots, 1, max(1, min(10_000, n_slots // (1 << 20)))).withColumn("u", point - F.floor(point))
    slots = slots.withColumn("cell", F.floor(F.col("u") * cells))
    spans = targets.where("high > low").select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))).alias("cell"))
    mapped = slots.join(spans, "cell").where("u >= low and u < high").select("id", "sid", F.floor(F.col("id") / CHUNK).alias("chunk"))
    totals = mapped.groupBy("sid", "chunk").count()
    totals = totals.select("sid", "chunk", F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("id")) - 1
    return mapped.withColumn("local", local).join(totals, ["sid", "chunk"]).select(F.col("id").alias("slot"), "sid", (F.col("base") + F.col("local")).alias("rank"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, slots.

    `slots` holds, for each pass that takes words of the document, the slot at
    which it first does: where a copy stands in the mix.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size")))
    per_source = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit))
    facts = per_source.agg(F.count("*").alias("sources"), F.max("total").alias("words")).first()
    n_sources, n_words, n_docs = facts["sources"], facts["words"] or 0, sized.count()
    block = max(1, min(block_words, n_words // (BLOCKS_PER_SOURCE * max(1, n_sources))))
    bits = min(31, (n_docs // RANGE_ROWS).bit_length())  # of the number of ranges

    # Offset of each document in the shuffled stream of its source.
    rows = sized.join(per_source.select(F.col("source").alias("s"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # The first hexadecimal digits of the shuffle key name its range, so ranges follow the order of the keys.
    h = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    rows = rows.withColumn("h", h).withColumn("range", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), 32 - bits).cast("int"))
    per_range = rows.groupBy("sid", "range").agg(F.sum("size").alias("w"))
    per_range = per_range.select("sid", "range", F.coalesce(F.sum("w").over(Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = rows.withColumn("local", _running(rows, ["sid"], "range", "size", ["h", "doc_id"])).join(per_range, ["sid", "range"])
    rows = rows.withColumn("at", F.col("base") + F.col("local"))

    # Slots: what each takes of its block, until the target is reached.
    needs = cut(slots_needed(per_source, block))
    n_slots = needs.agg(F.max("all_slots")).first()[0] or 0
    slots = schedule(needs, max(1, n_slots), n_sources)
    slots = slots.join(needs.where("source_size > 0").select("sid", "source_size", "n_blocks", "goal"), "sid")
    slots = slots.withColumns({"pass": F.expr("rank div n_blocks"), "block": F.col("rank") % F.col("n_blocks"), "start": F.expr(f"(rank div n_blocks) * source_size + (rank % n_blocks) * {block}")})
    slots = slots.where("start < goal").select("sid", "block", "pass", "slot", F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("goal") - F.col("start")).alias("words"))
    takes = slots.groupBy("sid", "block").agg(F.collect_list(F.struct("pass", "slot", "words")).alias("takes"))  # at most `limit` of them, rounded up

    # Pieces of documents, a row per block they touch; a document without words is one piece that no slot takes.
    pieces = rows.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).otherwise(F.array(F.lit(-1).cast("long")))))
    pieces = pieces.withColumns({"a": F.greatest(F.col("at") - F.col("block") * block, F.lit(0)), "b": F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block))})
    joined = pieces.join(takes, ["sid", "block"], "left")
    mine = F.filter("takes", lambda t: F.least(t["words"], F.col("b")) > F.col("a"))
    joined = joined.withColumn("mine", F.coalesce(mine, F.array().cast("array<struct<pass: bigint, slot: bigint, words: bigint>>")))
    got = F.aggregate("mine", F.lit(0).cast("long"), lambda n, t: n + F.least(t["words"], F.col("b")) - F.col("a"))
    passes = range(max(1, math.ceil(limit)) + 1)
    firsts = [F.min(F.array_min(F.transform(F.filter("mine", _of_pass(p)), lambda t: t["slot"]))).alias(f"slot{p}") for p in passes]
    out = joined.groupBy("doc_id", "source", "sid", "at", "size", "source_size", "target").agg(F.sum(got).alias("taken"), F.sum(F.lit(1)).alias("pieces"), *firsts)
    # Equal rows without words share one group; each comes back.
    out = out.withColumn("copies", F.when(F.col("size") > 0, 1).otherwise(F.col("pieces").cast("int")))
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", F.array_compact(F.array(*[f"slot{p}" for p in passes])).alias("slots"))


def _of_pass(n: int):
    return lambda take: take["pass"] == n


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
named AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source),
caps AS (SELECT *, CAST(1 + sid % 3 AS DOUBLE) AS w, 3.0::DOUBLE * ss AS cap, CAST(sum(ss) OVER () AS BIGINT) AS total, count(*) OVER () AS m FROM named),
ordered AS (SELECT *, row_number() OVER (ORDER BY cap / w, sid) AS nth FROM caps),
filled AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered),
targets AS (SELECT *, least(cap, w * coalesce((SELECT arg_min(level, nth) FROM filled WHERE level <= cap / w), 0)) AS target, CAST(greatest(1, least(64, total // (256 * m))) AS BIGINT) AS b FROM filled),
goals AS (SELECT *, CAST(round(target) AS BIGINT) AS goal, (ss + b - 1) // b AS nb FROM targets),
need AS (SELECT *, CASE WHEN ss > 0 AND goal > 0 THEN (goal // ss) * nb + (goal % ss + b - 1) // b + 32 ELSE 0 END AS slots FROM goals),
shares AS (SELECT *, CAST(sum(slots) OVER () AS BIGINT) AS n, CAST(sum(slots) OVER (ORDER BY sid) AS BIGINT) AS upto FROM need),
spans AS (SELECT *, CASE WHEN n > 0 THEN (upto - slots)::DOUBLE / n ELSE 0 END AS low, CASE WHEN n > 0 THEN upto::DOUBLE / n ELSE 0 END AS high FROM shares),
points AS (SELECT id, (id // 65536) * 0.4754867131087195::DOUBLE + (id % 65536 + 1) * 0.6180339887498949::DOUBLE AS x FROM (SELECT unnest(generate_series(0, greatest(1, (SELECT any_value(n) FROM spans)) - 1)) AS id)),
slots AS (SELECT id, x - floor(x) AS u FROM points),
ranked AS (SELECT s.sid, s.ss, s.b, s.goal, s.nb, id, row_number() OVER (PARTITION BY s.sid ORDER BY id) - 1 AS r FROM slots JOIN spans s ON u >= s.low AND u < s.high AND s.ss > 0),
takes AS (SELECT sid, id, r % nb AS block, least(b, ss - (r % nb) * b, goal - ((r // nb) * ss + (r % nb) * b)) AS words FROM ranked WHERE (r // nb) * ss + (r % nb) * b < goal),
placed AS (SELECT d.doc_id, d.size, s.ss, s.sid, s.b, s.target, row_number() OVER () AS row,
    coalesce(sum(size) OVER (PARTITION BY s.sid ORDER BY md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0
  FROM sized d JOIN spans s ON d.source IS NOT DISTINCT FROM s.source),
pieces AS (SELECT p.row, t.id, greatest(0, least(t.words, p.at0 + p.size - t.block * p.b) - greatest(0, p.at0 - t.block * p.b)) AS part
  FROM placed p JOIN takes t ON t.sid = p.sid AND t.block BETWEEN p.at0 // p.b AND (p.at0 + p.size - 1) // p.b WHERE p.size > 0),
got AS (SELECT row, sum(part) AS taken, min(id) AS first_slot FROM pieces WHERE part > 0 GROUP BY row)
SELECT doc_id, size, ss AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_slot FROM placed LEFT JOIN got USING (row)
"""
