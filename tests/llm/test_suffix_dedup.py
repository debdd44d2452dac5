import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import suffix_dedup as sd


def brute_force(texts, width):
    """Per text: n_bytes, spans, kept."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int)))))
        spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        out.append((len(d), spans, bytes(np.frombuffer(d, np.uint8)[~gone[:-1]]) if d else b""))
    return out


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], list(zip(r["removed_from"], r["removed_to"], strict=True)), bytes(r["kept"])) for r in df.collect()), key=str)


def expected(rows, width):
    return sorted(((d, *x) for (d, _), x in zip(rows, brute_force([t for _, t in rows], width), strict=True)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé日 ", k=rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (4, 8, 12, 20, 60, 200)]
    made = [(i, prose(rng.randrange(0, 60))) for i in range(40)]
    for i in range(40, 160):
        pieces = [rng.choice(shared) if rng.random() < 0.5 else prose(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))]
        piece = rng.choice(shared)
        at = rng.randrange(0, len(piece))
        made.append((i, " ".join([*pieces, piece[at : at + rng.randrange(1, 400)]])))
    made += [(200, made[50][1]), (201, made[50][1]), (50, made[50][1]), (51, "another text under an id that is there"), (None, shared[4]), (None, shared[4]), (202, None), (203, ""), (204, "é"), (205, "ab" * 40), (206, "x" * 500), (207, "abc" * 90)]
    return made


SMALL = {"block_bytes": 3000, "sample_bucket": 4000, "suffix_bucket": 3000}


@pytest.mark.parametrize(
    ("width", "sizes"),
    [(16, SMALL), (25, {}), (50, SMALL), (100, SMALL | {"hot": 1}), (100, SMALL | {"sample_bucket": 500, "step_bits": 2}), (230, SMALL), (400, SMALL)],
)
def test_equals_brute_force(spark, docs, rows, width, sizes):
    df = docs(rows).withColumn("_doc", F.lit(1)).withColumn("text_key", F.lit("x")).repartition(3)
    assert found(sd.suffix_dedup(df, width, **sizes)) == expected(rows, width)


def test_one_character_again_and_again(spark, docs):
    rows = [(1, "a" * 70_000), (2, "a" * 399), (3, "b" * 400), (4, "a" * 400), (5, "c" + "b" * 400 + "d")]
    out = {d: (spans, len(kept)) for d, _, spans, kept in found(sd.suffix_dedup(docs(rows)))}
    assert out == {1: ([(0, 70_000)], 0), 2: ([], 399), 3: ([(0, 400)], 0), 4: ([(0, 400)], 0), 5: ([(1, 401)], 2)}


def test_touching_spans_are_one_and_characters_may_be_cut(spark, docs):
    a, b = "q" + "é" * 30, "ü" * 30 + "z"
    rows = [(1, a + b), (2, a), (3, b), (4, "è" * 12)]
    assert found(sd.suffix_dedup(docs(rows), 61)) == expected(rows, 61)
    assert found(sd.suffix_dedup(docs([(1, "xé" + "y" * 20), (2, "zĩ" + "y" * 20)]), 21)) == expected([(1, "xé" + "y" * 20), (2, "zĩ" + "y" * 20)], 21)


def test_empty(spark, docs):
    assert sd.suffix_dedup(docs([])).collect() == []
    assert found(sd.suffix_dedup(docs([(1, None), (1, None), (None, "")]))) == [(1, 0, [], b""), (1, 0, [], b""), (None, 0, [], b"")]


@pytest.mark.parametrize("period", sd.COVERS)
def test_covers_hold_every_difference(period):
    residues = sd.COVERS[period]
    assert {(a - b) % period for a in residues for b in residues} == set(range(period))


@pytest.mark.parametrize("width", [16, 21, 60, 100, 230, 400])
@pytest.mark.parametrize("most", [1 << 20, 50])
def test_suffixes_of_a_bucket(width, most):
    rng = random.Random(width)
    base = "".join(rng.choices("ab", k=900))
    texts = [base[a : a + rng.randrange(width, 700)] + rng.choice(["", "b", "c"]) for a in (rng.randrange(200) for _ in range(12))]
    texts = list(dict.fromkeys(t for t in texts if len(t) >= width))
    suffixes = sd.Suffixes(pa.array([t.encode() for t in texts], pa.binary()), width)
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    starts = np.cumsum([0, *map(len, texts)])
    want = [int(s) + i for s, t in zip(starts, texts, strict=False) for i in range(len(t) - width + 1) if seen[t[i : i + width]] > 1]
    assert suffixes.repeated(most).tolist() == want


def test_ranks_of_samples_follow_their_bytes():
    rng = random.Random(2)
    text = "".join(rng.choices("ab", k=60)) * 12
    suffixes = sd.Suffixes(pa.array([text.encode()], pa.binary()), 100)
    v, d = suffixes.period, suffixes.residues
    at = [c * v + int(r) for c in range(len(text) // v + 1) for r in d]
    whole = [(text[p : p + suffixes.covered], int(suffixes.ranks[i])) for i, p in enumerate(at) if p + suffixes.covered <= len(text)]
    ordered = sorted(whole)
    assert [r for _, r in ordered] == sorted(r for _, r in whole)
    assert all((x[0] == y[0]) == (x[1] == y[1]) for x, y in zip(ordered, ordered[1:], strict=False))


def test_rows_of_samples_stay_long():
    # Two steps to the buckets: however many there are, a row of either step holds many samples.
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 1 << 63, 600_000, dtype=np.uint64) * np.uint64(2))
    for bits in (4, 20):
        first = sd._sample_rows(hashes, np.zeros(len(hashes), np.int64), min(bits, sd.STEP_BITS), 8)
        assert first.num_rows <= 1 << sd.STEP_BITS
        back, _ = sd._expanded(first, 8)
        assert (np.sort(back) == hashes).all()
    wide = sd._sample_rows(hashes, np.arange(len(hashes)) % 7, 0, 8)
    narrow = pa.Table.from_batches(list(sd._regroup(iter(wide.to_batches()), 6, 8)))
    assert narrow.num_rows == 64
    back, of = sd._expanded(narrow, 8)
    assert sorted(zip(back.tolist(), of.tolist(), strict=True)) == sorted(zip(hashes.tolist(), (np.arange(len(hashes)) % 7).tolist(), strict=True))
