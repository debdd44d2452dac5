import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import fusion


@pytest.mark.parametrize("kind", ["spread", "ties", "zero"])
def test_ranks_count_all_hits_before(spark, kind):
    rng = random.Random(3)
    score = {"spread": lambda: rng.random() ** 9, "ties": lambda: rng.choice([0.25, 0.5, 1e-20]), "zero": lambda: rng.choice([0.0, -1.0, 0.1])}[kind]
    hits = [(f"b{i}", score()) for i in range(500)]
    found = [(f"b{i}", f"c{i}", rng.random()) for i in range(0, 900, 7)]
    got = fusion.hybrid(spark.createDataFrame(found, "bookmark_id string, chunk_id string, similarity double"), spark.createDataFrame(hits, "bookmark_id string, rank double"), 40)
    order = {b: n for n, (b, _) in enumerate(sorted(hits, key=lambda h: (-h[1], h[0])), 1)}
    best = sorted(found, key=lambda f: (-f[2], f[1]))[:40]
    assert {r.chunk_id: (r.vector_rank, r.fts_rank, r.fts_score) for r in got.collect()} == {c: (n, order.get(b, 41), dict(hits).get(b, 0.0)) for n, (b, c, _) in enumerate(best, 1)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_levels_never_fall(spark):
    scores = sorted([0.0, -2.0, 1e-300, 1e-20, 0.1, 0.1000001, 0.5, 0.50001, 1.0, 7.0])
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select("s", fusion.score_level(F.col("s")).alias("l")).orderBy("s").collect()
    assert [r.l for r in rows] == sorted(r.l for r in rows) and rows[0].l == rows[1].l


def test_the_search_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(rank):
        seen.add(1)
        return rank

    hits = spark.range(200).select(F.concat(F.lit("b"), "id").alias("bookmark_id"), (F.col("id") % 9 / 9.0).alias("score")).repartition(3)
    hits = hits.select("bookmark_id", F.udf(counted, "double", useArrow=False)("score").alias("rank"))
    found = spark.range(30).select(F.concat(F.lit("b"), F.col("id") * 9).alias("bookmark_id"), F.col("id").cast("string").alias("chunk_id"), (F.col("id") / 100).alias("similarity"))
    rows = fusion.hybrid(found, hits, 12).collect()
    assert len(rows) == 12 and seen.value == 200


def test_rows_without_an_id_come_last_among_equals(spark):
    hits = spark.createDataFrame([(None, 0.5), ("a", 0.5), ("", 0.5), (None, 0.7)], "bookmark_id string, rank double")
    found = spark.createDataFrame([("a", "1", 0.9), (None, "2", 0.8), ("", "3", 0.7)], "bookmark_id string, chunk_id string, similarity double")
    got = {r.chunk_id: (r.fts_score, r.fts_rank) for r in fusion.hybrid(found, hits, 5).collect()}
    assert got == {"1": (0.5, 3), "2": (0.0, 6), "3": (0.5, 2)}
