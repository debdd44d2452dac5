"""Connected components by alternating large-star and small-star rounds (native).

The edges live in Spark throughout; a round is two aggregations with map-side
combine and two joins, and the edges are checkpointed after each.  The number
of rounds is about the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Edges of a task.
ROWS = 200_000


def _settled(edges: DataFrame) -> bool:
    """Whether every id is either a root or hangs on one root only, so that the edges are the components."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))))
    each = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return each.where((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("low") == 0))).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (smallest id reached) for every id of an edge between two different ids; ids are longs."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = cut(edges, ROWS)
    while not _settled(edges):
        # Large star: the larger neighbours of u go to the smallest of u's neighbours and u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours go to the smallest of those.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), ROWS)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
