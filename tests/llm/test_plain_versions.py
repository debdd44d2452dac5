"""The learned operators against plain loops, and the mix's order against its targets."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import quality, source_mix, toxicity
from quarry.llm.wordhash import Words, blocks, split_classes

TEXTS = ["You are a stupid, STUPID idiot!!! go go away", "a quiet morning by the river; nobody spoke", "", None, "WOW WOW, such SHOUTING", "été été über 日本 x", "one", "a b a b a a"]
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0D\x20]+")


def words_of(texts):
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    return [w for _, _, w in blocks(batch, cut=split_classes)]


def test_terms_are_words_and_their_beginnings():
    (words,) = words_of(TEXTS)
    term, at = toxicity.document_terms(words)
    for i, text in enumerate(TEXTS):
        want = set()
        for token in TOKEN.findall((text or "").encode()):
            if len(token) > 1:
                data = np.frombuffer(token, np.uint8)
                one = Words(data, np.array([0]), np.array([0]), np.array([len(data)]), np.array([0, 1]))
                want.add(int(one.hashes(fold_case=True)[0]))
                want |= {int(one.parts(np.array([0]), np.array([n]), fold_case=True, salt=31)[0]) for n in toxicity.PREFIXES if len(data) > n}
        assert set(term[at[i] : at[i + 1]].tolist()) == want


def test_machine_equals_a_double_loop():
    rng = np.random.default_rng(4)
    names = np.sort(rng.choice(10_000, 40, replace=False)).astype(np.uint64)
    machine = toxicity.FactorizationMachine(names, 0.3, rng.normal(size=40), rng.normal(size=(40, 5)))
    docs = [np.unique(rng.choice(np.concatenate([names, [7, 20_000]]).astype(np.uint64), rng.integers(0, 15))) for _ in range(60)]
    at = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    got = machine.logits(np.concatenate(docs), at)
    for d, z in zip(docs, got, strict=True):
        known = [names.tolist().index(t) for t in d.tolist() if t in names]
        want = 0.3 + sum(machine.weights[i] for i in known)
        for n, i in enumerate(known):
            for j in known[:n]:
                want += sum(machine.factors[i][k] * machine.factors[j][k] for k in range(5))
        assert math.isclose(z, want, rel_tol=1e-9, abs_tol=1e-9)


def test_context_vectors_equal_a_double_loop(spark, docs):
    sums = quality.context_sums(docs(list(enumerate(TEXTS))).repartition(3))
    dims, signs = quality.index_vectors()
    want = np.zeros_like(sums)
    for words in words_of(TEXTS):
        e, first = quality.entries(words), words.first
        for a, b in zip(first[:-1], first[1:], strict=True):
            for i in range(a, b):
                for j in range(a, b):
                    if 0 < abs(i - j) <= quality.REACH:
                        for k in range(quality.NONZERO):
                            want[e[i], dims[e[j], k]] += signs[e[j], k]
                        want[e[i], -1] += 1
    assert (sums == want).all() and sums[:, -1].sum() > 50


def test_scores_equal_a_plain_forward_pass(spark, docs):
    vectors = quality.WordVectors.of(quality.context_sums(docs(list(enumerate(TEXTS)))))
    rng = np.random.default_rng(6)
    d = vectors.table.shape[1] + 1
    net = quality.Network(rng.normal(size=d), 1 + rng.random(d), rng.normal(size=(d, 4)), rng.normal(size=4), rng.normal(size=4), 0.2, 1.7)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs(list(enumerate(TEXTS))), vectors, net).collect()}
    (words,) = words_of(TEXTS)
    e = quality.entries(words)
    for i in range(len(TEXTS)):
        own = e[words.first[i] : words.first[i + 1]].tolist()
        x = [sum(vectors.table[t][k] for t in own) / max(1, len(own)) for k in range(d - 1)] + [math.log1p(len(own))]
        hidden = [math.tanh(sum((x[k] - net.mean[k]) / net.scale[k] * net.w1[k][h] for k in range(d)) + net.b1[h]) for h in range(4)]
        logit = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2
        assert math.isclose(got[i], 1 / (1 + math.exp(-logit / net.temperature)), rel_tol=1e-9)


@pytest.fixture(scope="module")
def mixed(docs):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice((3, 40, 90)), rng.choice(["a", "b", "b", "c", "c", "c"])) for i in range(500)]
    return docs(rows)


def test_every_stretch_of_the_mix_is_near_the_targets(mixed):
    rows = source_mix.mix_sources(mixed).collect()
    target = {r.source: r.target for r in rows}
    copies = sorted((slot, r.source, min(r["size"], r.taken - n * r["size"])) for r in rows for n, slot in enumerate(r.slots))
    assert sum(w for _, _, w in copies) == sum(r.taken for r in rows)
    taken, total, goal = dict.fromkeys(target, 0), 0, sum(target.values())
    for _, source, words in copies:
        taken[source] += words
        total += words
        # A prefix differs from its share by some documents, not by a part of the corpus.
        assert all(abs(taken[s] - total * target[s] / goal) <= 500 for s in target), (total, taken)


def test_the_result_is_the_schedules(mixed, monkeypatch):
    before = {(r.doc_id, tuple(r.slots)) for r in source_mix.mix_sources(mixed).collect()}
    real = source_mix.schedule

    def plain(targets, n_slots, n_sources):
        # Sources one after the other.
        found = real(targets, n_slots, n_sources)
        return found.select((found["sid"].cast("long") * 1_000_000 + found["rank"]).alias("slot"), "sid", "rank")

    monkeypatch.setattr(source_mix, "schedule", plain)
    after = {(r.doc_id, tuple(r.slots)) for r in source_mix.mix_sources(mixed).collect()}
    assert before != after and len(before & after) < 0.9 * len(before)
