import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import vector
from quarry.operators.vector_index import VectorIndex, clusters

SCHEMA = "chunk_id long, embedding array<double>, other string"


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, v.tolist(), "x") for i, v in enumerate(vectors)], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(60, 16))
    return centers[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 16))


def truth(vectors, query, k):
    s = vectors @ query / np.linalg.norm(vectors, axis=1) / np.linalg.norm(query)
    return set(np.lexsort((np.arange(len(s)), -s))[:k].tolist())


def queries_of(spark, vectors):
    return spark.createDataFrame([(int(i), vectors[i].tolist()) for i in range(0, 6000, 200)], "query_id long, query array<double>")


@pytest.mark.parametrize(("cells", "probes", "part_rows"), [(4096, 96, 100_000), (64, 8, 40)])
def test_recall_of_a_batch_with_later_rows(spark, vectors, cells, probes, part_rows):
    first = frame(spark, vectors[:4500])
    built = VectorIndex.fit(first, cells, parts=8)
    assert len(built.cells) <= 1.3 * cells and (cells < 4096 or len(built.cells) > 1500)
    late = frame(spark, vectors[4500:], 4500)
    index = built.assigned(first).unionByName(built.assigned(late))
    assert index.count() == 6000
    rows = built.nearest_batch(index, first.unionByName(late), queries_of(spark, vectors), 10, probes, candidates=60, part_rows=part_rows).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.similarity))
    assert len(found) == 30
    for q, hits in found.items():
        assert [h[0] for h in sorted(hits)] == list(range(1, 11))
        assert all(abs(s - vectors[c] @ vectors[q] / np.linalg.norm(vectors[c]) / np.linalg.norm(vectors[q])) < 1e-9 for _, c, s in hits)
    recall = np.mean([len({c for _, c, _ in hits} & truth(vectors, vectors[q], 10)) / 10 for q, hits in found.items()])
    assert recall >= 0.9


def test_all_cells_and_candidates_give_the_exact_answer(spark, vectors):
    c = frame(spark, vectors[:500])
    built = VectorIndex.fit(c, 9, parts=4)
    q = queries_of(spark, vectors).where("query_id < 500")
    got = built.nearest_batch(built.assigned(c), c, q, 7, probes=99, candidates=500).select("query_id", "chunk_id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vector.nearest_batch(c, q, 7).select("query_id", "chunk_id", "rank").collect()))


def test_rows_without_a_vector_are_not_in_the_index(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, None, "b"), (3, [0.0, 0.0], "c"), (4, [1.0, 0.0, 0.0], "d"), (5, [0.0, 2.0], "e")], SCHEMA)
    built = VectorIndex.fit(c.where("chunk_id in (1, 5)"), 2, parts=1)
    assert {r.chunk_id for r in built.assigned(c).collect()} == {1, 5}
    with pytest.raises(ValueError):
        VectorIndex.fit(c.where("chunk_id = 2"), 2, parts=1)
    with pytest.raises(ValueError):
        VectorIndex.fit(c.where("chunk_id = 1"), 1, parts=3)


def test_clusters():
    points = np.array([[0.0, 0.0], [0.0, 0.1], [5.0, 5.0], [5.0, 5.1], [9.0, 0.0]])
    assert len(clusters(points, 10)) == 5
    found = clusters(np.repeat(points, 20, axis=0), 3)
    assert sorted(np.round(found).astype(int).tolist()) == [[0, 0], [5, 5], [9, 0]]


def test_batches_equal_single_queries(spark):
    rng = np.random.default_rng(1)
    rows = rng.integers(-2, 3, size=(300, 4)).astype(float)  # many ties and zero vectors
    c = frame(spark, rows).unionByName(spark.createDataFrame([(900, None, "x"), (901, [1.0], "x")], SCHEMA))
    q = spark.createDataFrame([(i, rows[i].tolist()) for i in range(12)] + [(50, [1.0]), (51, [0.0] * 4)], "query_id int, query array<double>")
    got = {}
    for r in vector.nearest_batch(c, q, 6, 0.2, most=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.similarity, 9)))
    for i in range(12):
        # One query meets chunks by the plain expression.
        want = [(r.chunk_id, round(r.similarity, 9)) for r in vector.nearest(c.where(F.size("embedding") == 4), rows[i].tolist(), 300, 0.2).collect()]
        assert [s for _, s in got.get(i, [])] == [s for _, s in want[:6]]
        assert set(got.get(i, [])) <= set(want)
    assert got[50] == [(901, 1.0)] and 51 not in got


def test_blocks_of_queries_give_the_same_candidates(spark, vectors):
    c, q = frame(spark, vectors[:800]), queries_of(spark, vectors)
    built = VectorIndex.fit(c, 9, parts=4)
    index = built.assigned(c)
    rows = lambda **sizes: sorted((r.query_id, r["rank"], r.chunk_id) for r in built.nearest_batch(index, c, q, 5, probes=6, candidates=20, **sizes).collect())
    want = rows()
    assert len(want) == 150 and rows(most=2) == want and rows(most=4, part_rows=30) == want


def test_probes_leave_in_small_batches(spark, vectors, monkeypatch):
    monkeypatch.setattr("quarry.operators.vector_index.PROBE_ROWS", 20)
    c, q = frame(spark, vectors[:500]), queries_of(spark, vectors)
    built = VectorIndex.fit(c, 9, parts=4)
    assert {r.n for r in built.probes(q, 6).groupBy("query_id").agg(F.countDistinct("cell").alias("n")).collect()} == {6}


def test_copies_do_not_fill_the_sample(spark, vectors):
    c = frame(spark, np.repeat(vectors[:300], 50, axis=0))
    built = VectorIndex.fit(c, 4, parts=4)
    assert len(built.cells) >= 4 and all(len(w) >= 150 for w in built.words)


def test_ties_of_a_block_are_settled_in_its_task():
    """Copies of one vector: k rows of each query leave, those of the smallest keys."""
    same = pa.FixedSizeListArray.from_arrays(pa.array([1.0, 2.0] * 64), 2).cast(pa.list_(pa.float64()))
    keys = [str(i) for i in range(64)]
    chunks = pa.table({"chunk_id": keys[::-1], "v": same, "_order": list(range(64))})
    queries = pa.table({"query_id": [7, 8], "v": same[:2]})
    found = vector._scored(chunks, queries, 3, None, "chunk_id")
    assert sorted(zip(found["query_id"].to_pylist(), found["chunk_id"].to_pylist(), strict=True)) == [(q, c) for q in (7, 8) for c in sorted(keys)[:3]]
