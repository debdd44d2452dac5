import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score string, c string, q string, v string, place int"


def rows_of(vectors):
    return [(i, v, label, "x", "x", "x", "x", 1) for i, v, label in vectors]


def brute_force(vectors, positives, negatives, every, scale=hn.SCALE):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in vectors if i is not None and label is not None and good(v)]
    anchors = {}
    for i, v, label in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, w, other in rows if i != a and len(w) == len(v)]
        for p_score, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            kept = sorted(x for x in scored if x[2] != label and 30 * -p_score <= 100 * -x[0] <= 90 * -p_score)[:negatives]
            out += [(a, p, rank, n, -p_score, -s) for rank, (s, n, _) in enumerate(kept, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    made = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 0.75, 2.0]) for _ in range(11)], rng.randrange(3)) for i in range(240)]
    made += [(i, list(made[i][1]), made[i][2]) for i in (10, 20, 33, 34)]  # repeated rows, of an anchor too
    made += [(20, made[1][1], 0), (501, [0.5] * 3, 1), (500, [0.25, 1.0, -3.0], 1), (502, [0.5, 0.5, -1.0], 2), (503, [], 1), (510, [], 2)]
    made += [(504, None, 1), (505, [None] * 11, 1), (506, [float("nan")] * 11, 1), (507, [float("inf")] * 11, 2), (508, [1.0] * 11, None), (None, [1.0] * 11, 1)]
    return made


@pytest.mark.parametrize("block", [7, 64, 16_384])
def test_equals_brute_force(spark, vectors, block):
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(3)
    assert found(hn.hard_negatives(df, positives=3, negatives=4, anchor_every=10, block=block)) == brute_force(vectors, 3, 4, 10)


def test_scores_by_lookups_are_inner_products():
    rng = np.random.default_rng(1)
    for dims in (1, 7, 8, 9, 64):
        for top in (1, 5, 1000, 1 << 40):
            vectors, anchor = rng.integers(-top, top + 1, (50, dims)), rng.integers(-1000, 1001, dims)
            planes = hn.BitPlanes(vectors)
            assert (planes.scores(hn.subset_sums(anchor), slice(0, 50)) == vectors @ anchor).all()
            assert (planes.scores(hn.subset_sums(anchor), slice(3, 9)) == (vectors @ anchor)[3:9]).all()


def test_subset_sums_table_all_subsets():
    sums = hn.subset_sums(np.array([3, -5, 7, 11, 13, 17, 19, 23, 29]))
    assert sums.shape == (2, 256)
    assert sums[0, 0b101] == 10 and sums[0, 255] == 88 and sums[1, 1] == 29 and sums[1, 2] == 0


def test_empty(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hn.hard_negatives(spark.createDataFrame(rows_of([(100, None, 1)]), SCHEMA)).collect() == []


def test_agrees_with_its_sql(spark, sf_dir):
    from quarry.llm.queries import op13_hard_negatives

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    assert found(op13_hard_negatives(spark, sf_dir)) == sorted(con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({hn.ORACLE})").fetchall())


def test_sql_on_repeats_and_nulls(spark, vectors):
    # As the query, with labels changed where vec_id is divisible by 7, and anchors divisible by 100.
    moved = [(i, v, label) for i, v, label in vectors]
    con = duckdb.connect()
    table = pa.table({"vec_id": pa.array([r[0] for r in moved], pa.int64()), "embedding": pa.array([r[1] for r in moved], pa.list_(pa.float64())), "label": pa.array([r[2] for r in moved], pa.int32())})
    con.register("embeddings", table)
    own = [(i, v, (label + 1) % 10 if label is not None and i is not None and i % 7 == 0 else label) for i, v, label in moved]
    rows = con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({hn.ORACLE})").fetchall()
    assert sorted(rows) == brute_force(own, 5, 10, 100)
