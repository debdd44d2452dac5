"""The other operators against exact round trips, brute force and held-out labels."""

import hashlib
import io
import math
import random
import wave
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quarry.llm import byte_bpe, exact_topk, media_columns, quality, source_mix, toxicity, url_filters

from .conftest import words

TEXTS = [(1, "Hello world, it's 42!  \n\n x"), (2, None), (3, ""), (4, "Grüße <|endoftext|> <unk> ▁ \x00 日本語 🎉"), (1, "Hello world, it's 42!  \n\n x"), (None, " "), (5, "naïve\t\tcafé " * 3000)]


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return byte_bpe.read_ranks(f.read())


def test_byte_bpe(docs, ranks):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = byte_bpe.byte_bpe(docs(TEXTS), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    want = []
    for i, t in TEXTS:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in found), key=repr) == sorted(want, key=repr)


def test_byte_bpe_of_the_tables(spark, sf_dir, ranks):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r.doc_id: r.ids for r in byte_bpe.byte_bpe(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert found == {r.doc_id: reference.encode_ordinary(r.text) for r in d.collect()}


def test_media(docs):
    found = media_columns.media_columns(docs(TEXTS)).collect()
    assert len(found) == len(TEXTS)
    by_text = {}
    for r in found:
        text = next((t or "").encode() for i, t in TEXTS if i == r.doc_id)
        padded = text + b" " * (-len(text) % 192 if text else 192)
        with wave.open(io.BytesIO(r.media)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-16:]), len(r.media), hashlib.sha256(r.media).hexdigest())
        assert len(r.fingerprint_time) == len(r.fingerprint_code)
        by_text.setdefault(text, set()).add(r.feature)
    assert all(len(f) == 1 for f in by_text.values())
    assert len({f for s in by_text.values() for f in s}) > 2


def plain_fingerprints(samples):
    """A plain discrete Fourier transform of every frame, its strongest bins, and all pairs of bins of near frames."""
    n, hop = media_columns.FRAME, media_columns.HOP
    frames = max(1, math.ceil((len(samples) - n + hop) / hop))
    data = list(samples) + [128] * ((frames - 1) * hop + n - len(samples))
    window = np.hanning(n).astype(np.float32)
    k = np.arange(1, n // 2 + 1)[:, None] * np.arange(n)[None, :]
    turns = np.exp(-2j * np.pi * k / n)
    peaks = []
    for f in range(frames):
        frame = (np.array(data[f * hop : f * hop + n], np.float32) - 128) * window
        power = np.round(np.abs(turns @ frame), 2).tolist()
        peaks.append(sorted(range(1, n // 2 + 1), key=lambda b: (-power[b - 1], b))[: media_columns.PEAKS])
    found = []
    for f, own in enumerate(peaks):
        found += [(f, own[i] << 12 | own[i + 1] << 4) for i in range(media_columns.PEAKS - 1)]
        for d in range(1, media_columns.FAN_OUT + 1):
            found += [(f, a << 12 | b << 4 | d) for a in own for b in (peaks[f + d] if f + d < frames else ())]
    return sorted(found)


def test_fingerprints_against_a_plain_transform():
    rng = np.random.default_rng(8)
    for n in (192, 384, 1920):
        samples = rng.integers(32, 123, n).astype(np.uint8)
        time, code = media_columns.fingerprints(media_columns.spectral_peaks(samples))
        assert list(zip(time.tolist(), code.tolist(), strict=True)) == plain_fingerprints(samples.tolist())


def test_spectral_peaks_find_a_tone():
    t = np.arange(4000)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 20 / media_columns.FRAME)).astype(np.uint8)
    assert (media_columns.spectral_peaks(tone)[:-1, 0] == 20).all()


def test_topk(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(700)}
    vectors[301], vectors[302], vectors[400] = vectors[300], vectors[300], [0.0] * 8
    rows = [(i, v, "x") for i, v in vectors.items()] + [(900, None, "x"), (901, [None] * 8, "x"), (902, [float("nan")] * 8, "x"), (1000, [math.inf] * 8, "x"), (903, [1.0], "x"), (None, [0.5] * 8, "x"), (5, vectors[5], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    ints = {i: [math.floor(1024 * float(x)) for x in v] for i, v in vectors.items()}
    want = set()
    for q in range(0, 700, 100):
        # A row that repeats another is a candidate of its own.
        scores = sorted(((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in [*ints, 5] if c != q))[:10]
        want |= {(q, n, c, -s) for n, (s, c) in enumerate(scores, 1)}
    assert {tuple(r) for r in exact_topk.exact_topk(df).collect()} == want
    few = spark.createDataFrame([(0, [1.0], 1), (7, [1.0], 1), (8, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, exact_topk.exact_topk(few).collect())) == [(0, 1, 7, 1024 * 1024), (0, 2, 8, 1024 * 1024)]
    assert exact_topk.exact_topk(few.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [-1.0]), (7, [1.0]), (7, [1.0]), (8, [2.0])], "vec_id long, embedding array<float>")
    # The query is the smallest of its vectors; no row of its id is a candidate.
    assert sorted(map(tuple, exact_topk.exact_topk(twice).collect())) == [(0, 1, 7, -1024 * 1024), (0, 2, 7, -1024 * 1024), (0, 3, 8, -2 * 1024 * 1024)]


def test_threshold_stops_early():
    rng = np.random.default_rng(2)
    vectors = np.abs(rng.normal(size=(4000, 3)))
    vectors[17] = 100
    ids, scores = exact_topk.SortedLists(np.arange(4000), vectors).search(np.ones(3), -1, 1, -np.inf)
    assert ids.tolist() == [17] and scores.tolist() == [300]


def test_url_filters(spark):
    urls = ["http://example.org/es/1", "http://a.example.org/en/12", "http://example.org/en/2", "https://EXAMPLE.com/de/?x", "http://b.com/fr/x", "http://b.com/fr", "http://net/x", "x", None, "http://", "http://example.org", "http://notexample.org/es/", "ftp://org/#f", "http://example.org:80/es/"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filter(df).collect()}
    want = [
        ("example.org", "/es/1", "example.org/es/", "block"), ("a.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("example.com", "/de/", "com/de/", "block"),
        ("b.com", "/fr/x", "com/fr/", "allow"), ("b.com", "/fr", None, "allow"), ("net", "/x", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("example.org", "", None, "allow"), ("notexample.org", "/es/", "org/", "allow"), ("org", "/", "org/", "allow"), ("example.org:80", "/es/", None, "allow"), ("example.org", "/es/1", "example.org/es/", "block"),
    ]
    assert found == dict(enumerate(want))
    assert url_filters.url_filter(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://" + "a." * 200_000 + "org/es/" + "x/" * 200_000), (2, "http://" + "." * 100_000 + "org/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filters.url_filter(long).orderBy("page_id").collect()] == [("org/", "allow")] * 2


def targets(sizes):
    """Brute force: share by weight, cap, share again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(docs, seed):
    rng = random.Random(seed)
    names = ["a", "b", "B", "é", "z", None, "hot"]
    rows = [(i, "w " * rng.choice((0, 1, 5, 40, 300)), "hot" if rng.random() < 0.4 else rng.choice(names[: rng.randint(2, 7)])) for i in range(300)] + [(None, None, None), (7, "x", "a"), (7, "x", "a")]
    found = source_mix.mix_sources(docs(rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, taken = targets(sizes), Counter()
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= 1 + 0.01 * target
    again = source_mix.mix_sources(docs(rows).repartition(3)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_mix_of_small_sources_in_a_large_table(docs):
    """Blocks are of full length here, and the last one of a source is partial."""
    few = {"a5": 5, "b20": 20, "k65": 65, "m100": 100, None: 5, "z300": 300}
    rows = [(i, "w " * 2000, f"h{i % 3}") for i in range(300)] + [(1000 + i, "w " * n, s) for i, (s, n) in enumerate(few.items())]
    taken = Counter()
    for r in source_mix.mix_sources(docs(rows)).collect():
        taken[r.source] += r.taken
    want = targets(Counter(few) + Counter({f"h{i}": 200_000 for i in range(3)}))
    assert all(want[s] == 3 * n for s, n in few.items())
    assert {s: round(t) for s, t in want.items()} == dict(taken)


def test_mix_of_nothing(docs):
    assert source_mix.mix_sources(docs([])).count() == 0
    assert [(r["size"], r.taken, r.target) for r in source_mix.mix_sources(docs([(1, ""), (1, "")])).collect()] == [(0, 0, 0.0)] * 2


def held_out_accuracy(rows, labels):
    labels = {r.doc_id: r[1] for r in labels.collect()}
    pairs = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(a == b for a, b in pairs) / len(pairs), len(pairs)


def test_toxicity_and_quality_on_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity.toxicity_scores(docs, toxicity.train(docs, labels)).collect()
    accuracy, n = held_out_accuracy(rows, labels.select("doc_id", "toxic"))
    assert n > 500 and accuracy > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows[:500])
    rows = quality.quality_scores(docs, *quality.train(docs, labels)).collect()
    accuracy, n = held_out_accuracy(rows, labels.select("doc_id", "quality"))
    assert n > 500 and accuracy > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows[:500])


def test_pairs_of_terms_weigh_more_than_their_sum():
    """Label 1 needs both of two terms, which no sum of weights can say with margin; the factors can."""
    rng = np.random.default_rng(3)
    docs = [np.sort(rng.choice([10, 20, 30, 40, 50], rng.integers(1, 5), replace=False)).astype(np.uint64) for _ in range(600)]
    label = np.array([float(10 in d and 20 in d) for d in docs])
    at = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    names, features = np.unique(np.concatenate(docs), return_inverse=True)
    machine = toxicity.fit(names, features, at, label)
    a, b = (int(np.searchsorted(machine.terms, x)) for x in (10, 20))
    assert ((machine.logits(np.concatenate(docs), at) > 0) == (label == 1)).mean() > 0.97
    assert machine.factors[a] @ machine.factors[b] > 0.1


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_classifiers_on_odd_rows(spark, docs, kind):
    d = docs(TEXTS)
    for rows in ([], [(1, 1, 1), (4, 0, 0)], [(1, 1, 1), (1, 0, 0), (4, None, None), (None, 1, 1), (4, 0, 0), (5, 0, 0), (6, 1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        if kind == "toxicity":
            found = toxicity.toxicity_scores(d, toxicity.train(d, labels))
        else:
            found = quality.quality_scores(d, *quality.train(d, labels))
        found = found.collect()
        assert len(found) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
        assert len({r.score for r in found if r.doc_id == 1}) == 1
    empty = docs([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(empty, toxicity.train(empty, labels)).count() == 0
    assert quality.quality_scores(empty, *quality.train(empty, labels)).count() == 0
