import math
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from quarry.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute_force(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        wanted, scored = Counter(terms(text)), []
        for doc, c in held:
            if doc is None:
                continue
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in wanted.items() if c[t])
            scored.append((-score, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "日本語", "x_y", "a-b", "Co2"]
    made = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rng.randrange(1, 60)))) for i in range(300)]
    made += [(900, made[3][1]), (901, made[3][1]), (7, made[7][1]), (7, "w1 w2 w3"), (None, "w1 w5 w59"), (902, None), (903, ""), (904, "... ,\n\t"), (905, "w40 " * 20_000)]
    return made


ITEMS = [(1, "w1 W2 w59 w59"), (2, "ÉTÉ Straße 日本語"), (3, ""), (4, None), (5, "nobody has this"), (1, "w40 w41"), (1, "w40 w41"), (None, "x_y co2 CO2"), (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w58")]


@pytest.mark.parametrize("group_bytes", [2000, 1 << 25])
def test_equals_brute_force(spark, docs, corpus, group_bytes):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, term string, weight int")
    assert found(ls.lexical_search(docs(corpus).repartition(5), items, k=7, group_bytes=group_bytes)) == brute_force(corpus, ITEMS, 7)


def test_sql_says_the_same(corpus):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in corpus], pa.int64()), "text": [t for _, t in corpus]}))
    con.register("benchmark", pa.table({"item_id": pa.array([i for i, _ in ITEMS], pa.int64()), "text": [t for _, t in ITEMS]}))
    assert sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ls.ORACLE})").fetchall(), key=str) == brute_force(corpus, ITEMS, 20)


def test_accumulators_stop_and_survivors_are_exact():
    rare, common = [f"r{i}" for i in range(30)], "the"
    texts = [" ".join(rare) + " the"] * 5 + ["the and of"] * 500
    index = pa.concat_tables([pa.Table.from_batches([b]) for b in ls._index(iter([pa.record_batch({"doc_id": list(range(505)), "text": texts})]), type("Everything", (), {"value": __import__("numpy").ones(ls.MAP_BITS, bool)}))])
    postings = ls.Postings(index, 505, 5 * 31 + 1500)
    ids, scores, made = ls.best_of(postings, [*rare, common], [5000] * 30 + [1], 3)
    assert ids.tolist() == [0, 1, 2] and made == 5  # `the` made none
    every = sum(5000 * int(postings.of(t)[1][0]) for t in rare) + int(postings.of("the")[1][0])
    assert scores.tolist() == [every] * 3


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "w1")], "item_id string, text string")
    assert ls.lexical_search(docs([]), items).collect() == []
    assert ls.lexical_search(docs([(1, None), (2, " ")]), items).collect() == []
    assert ls.lexical_search(docs([(1, "w1")]), items.limit(0)).collect() == []
    assert [tuple(r) for r in ls.lexical_search(docs([(1, "w1"), (2, "w2")]), items).select("item_id", "rank", "doc_id").collect()] == [("1", 1, 1)]
