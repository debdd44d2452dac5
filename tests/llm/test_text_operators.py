"""Dedup operators against brute force, on fixtures and on odd inputs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import line_dedup, ngram_jaccard, shared, substring_dedup, wordhash
from quarry.llm.components import components

from .conftest import words

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, "ONE two"), (7, "é" * 5), (8, "w " * 3000)]


def corpus(seed, n=160):
    """Random texts with exact copies, near copies, shared passages and one passage that a third of all rows hold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(40)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            text = rng.choice(texts)
        elif texts and kind < 0.5:
            text = [w if rng.random() > 0.02 else word() for w in rng.choice(texts)]
        else:
            text = [word() for _ in range(rng.choice((0, 2, 4, 5, 30, 120)))]
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text = text[:at] + passage + text[at:]
        texts.append(text)
    ids = list(range(n))
    rng.shuffle(ids)
    return [(i, "".join(w + rng.choice((" ", " ", "\n")) for w in t)) for i, t in zip(ids, texts, strict=True)]


def shingles(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("seed", "crowd"), [(1, 400), (2, 2), (3, 5)])
def test_jaccard_components(docs, seed, crowd):
    rows = corpus(seed)
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0]
    want = roots_of(pairs, sets)
    found = ngram_jaccard.ngram_jaccard(docs(rows), crowd=crowd, tile_size=crowd).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(s), want[i]) for i, s in sets.items()}
    assert pairs


def test_jaccard_hot_tiles_of_near_misses(docs):
    """Crowded tiles in small blocks and slices of few pairs: boilerplate, near misses and chains without a hub."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    boiler, rows = [word() for _ in range(60)], []
    for group in range(6):
        own = [word() for _ in range(20 + 8 * group)]
        for k in range(14):
            # The tail moves on along the group, so neighbours link and ends do not; between groups all share the boilerplate.
            tail = [f"g{group}t{i}" for i in range(3 * k, 3 * k + 24)]
            rows.append((len(rows) * 37 % 997, " ".join(boiler + own + tail)))
    rows += [(2000 + i, " ".join(boiler + [word() for _ in range(22 + i % 9)])) for i in range(40)]
    sets = {i: shingles(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and 60 * len(sets[a] | sets[b]) <= 100 * len(sets[a] & sets[b]) < 75 * len(sets[a] | sets[b])]
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(near) > 200 and len(pairs) > 100
    want = roots_of(pairs, sets)
    for block, per_member in ((8, 2), (2048, 1)):
        found = ngram_jaccard.ngram_jaccard(docs(rows), crowd=3, tile_size=3, block=block, per_member=per_member).collect()
        assert {r.doc_id: r.component_id for r in found} == want


def test_jaccard_odd_rows(docs):
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard(docs(ODD)).collect()), key=repr)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, None), (6, 1, 4), (7, 1, 7), (8, 1, 8)]
    assert found == sorted(want, key=repr)
    assert ngram_jaccard.ngram_jaccard(docs([])).count() == 0


def test_short_prefixes_are_safe():
    for n in range(1, 3000):
        exact = n - -(-75 * n // 100) + 1
        assert 1 <= ngram_jaccard.prefix_length(n, n, 75) <= exact
        assert ngram_jaccard.prefix_length(n, 0, 75) == exact
    assert ngram_jaccard.prefix_length(1000, 1000, 75) == 38


def cut_out(rows, width=13):
    """Brute force of the contract."""
    first, lists = {}, {}
    for i, t in rows:
        lists[i] = words(t)
        for k in range(len(lists[i]) - width + 1):
            w = tuple(lists[i][k : k + width])
            first[w] = min(i, first.get(w, i))
    out = {}
    for i, w in lists.items():
        gone = {p for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(docs, seed):
    rows = corpus(seed)
    found = substring_dedup.substring_dedup(docs(rows), buckets=3).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == cut_out(rows)
    for r in found:
        spans = list(zip(r.removed_from or [], r.removed_to or [], strict=True))
        assert sum(b - a for a, b in spans) == r.n_removed and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False)) or r.n_removed >= 0


def test_substrings_across_partitions(docs):
    rows = corpus(5)
    found = substring_dedup.substring_dedup(docs(rows).repartition(7)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == cut_out(rows)


@pytest.mark.parametrize("buckets", [5, 40])
def test_substrings_with_buckets_in_two_steps(docs, buckets):
    rows = corpus(6)
    found = substring_dedup.substring_dedup(docs(rows).repartition(9), buckets=buckets, step=4).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == cut_out(rows)
    assert substring_dedup.substring_dedup(docs([]), buckets=buckets, step=4).count() == 0


def test_substring_rows_stay_long_whatever_the_number_of_buckets():
    rng = np.random.default_rng(3)
    blocks, windows = 2000, 1_400_000  # as 8 MB of text have
    for n_buckets in (10, 4096, 100_000, 1_000_000):
        within = -(-n_buckets // substring_dedup.STEP_BUCKETS)
        block, bucket = np.sort(rng.integers(0, blocks, windows)), rng.integers(0, within, windows)
        block[0] = 0
        rows = []
        for a, b in substring_dedup._runs(block):
            cells = substring_dedup._pack_ids(block[a:b]), substring_dedup._narrow(np.ones(b - a, int)), substring_dedup._gaps(np.arange(b - a))
            rows.append((7, int(block[a]), substring_dedup.JUDGE, *cells, rng.integers(0, 1 << 62, b - a).astype("<u8").tobytes(), substring_dedup._narrow(bucket[a:b])))
        group = substring_dedup._table(rows, substring_dedup._COLUMNS)
        out = substring_dedup._regroup(group.append_column("part", pa.array([0] * len(rows))), within)
        assert out.num_rows <= within and out.nbytes < 25 * windows
        # One window that every block has goes on once.
        cells = substring_dedup._pack_ids(np.array([5])), substring_dedup._narrow(np.array([1])), substring_dedup._gaps(np.array([3])), bytes(8), substring_dedup._narrow(np.array([0]))
        hot = substring_dedup._table([(7, b, substring_dedup.JUDGE, substring_dedup._pack_ids(np.array([b])), *cells[1:]) for b in range(blocks)], substring_dedup._COLUMNS)
        out = substring_dedup._regroup(hot.append_column("part", pa.array([0] * blocks)), within).to_pylist()
        assert [r["kind"] for r in out].count(substring_dedup.JUDGE) == 1 and len(out) == blocks


def test_substring_rows_of_a_block():
    text = " ".join(f"w{i}" for i in range(60_000))
    batch = pa.record_batch([pa.array([1]), pa.array([text]), pa.array([2])], names=["doc_id", "text", "text_key"])
    ((a, b, found),) = wordhash.blocks(batch)
    for n_buckets in (10, 4096, 1_000_000):
        within = -(-n_buckets // substring_dedup.STEP_BUCKETS)
        ranges = min(n_buckets, substring_dedup.STEP_BUCKETS)
        rows = list(substring_dedup._by_bucket(found, np.array([2]), 13, ranges * within, ranges, 0))
        assert len(rows) <= ranges + 1


def test_substrings_odd_rows(docs):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [*ODD, (20, long), (20, long), (21, long), (None, long), (-5, " ".join(f"w{i}" for i in range(13)))]
    found = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs(rows)).collect()), key=repr)
    kept = dict(Counter(found))
    assert kept[(20, 20, 13)] == 2 and kept[(21, 20, 20)] == 1 and kept[(None, 20, 0)] == 1 and kept[(8, 3000, 0)] == 1
    assert len(found) == len(rows)
    assert substring_dedup.substring_dedup(docs([])).count() == 0
    again = ((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs(rows), buckets=9, step=2).collect())
    assert sorted(again, key=repr) == found


def similar(a, b, shingle=6):
    a, b = ({x[i : i + shingle] for i in range(max(1, len(x) - shingle + 1))} for x in (a, b))
    return len(a & b) >= 0.8 * len(a | b)


def test_lines(docs):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij klmnop") for _ in range(rng.choice((8, 60, 200, 400)))).strip() for _ in range(40)]
    # Copies either resemble their line closely, or not at all, so that every band scheme must agree.
    lines = base + [x[: len(x) // 2] + "Z" + x[len(x) // 2 :] for x in base if len(x) > 150] + base[:20] + ["Z" * 3, "Z" * 3, ""] * 4
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(len(lines) // 4)]
    seen: list[str] = []
    want = {}
    different = list(dict.fromkeys(x.strip() for _, t in rows for x in t.split("\n") if x.strip()))
    root = roots_of([(a, b) for a in range(len(different)) for b in range(a + 1, len(different)) if similar(different[a], different[b])], range(len(different)))
    place = {x: root[i] for i, x in enumerate(different)}
    for i, t in sorted(rows):
        kept = []
        for x in t.split("\n"):
            if not x.strip() or place[x.strip()] not in seen:
                kept.append(x)
            if x.strip():
                seen.append(place[x.strip()])
        want[i] = "\n".join(kept)
    found = line_dedup.line_dedup(docs(rows)).collect()
    assert {r.doc_id: r.text for r in found} == want


def templated(rng, groups=150):
    """Groups of two lines that closely resemble each other, all groups sharing a template of three quarters of their text."""
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    template, out = word(90), []
    for _ in range(groups):
        own = word(30)
        out += [template + own, template + own[:-2] + word(2)]
    return out


def test_templated_lines_meet_all_their_mates(docs):
    lines = templated(random.Random(11))
    root = roots_of([(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if similar(lines[a], lines[b])], range(len(lines)))
    assert len(set(root.values())) == len(lines) // 2
    found = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(docs(list(enumerate(lines)))).collect()}
    # A pair may miss each other in all bands, but hardly any does.
    assert all(found[i] == 0 for i in root.values())
    assert sum(found.values()) >= 0.98 * (len(lines) // 2)


def test_last_round_tries_all_mates(spark, docs):
    """With one bucket for all lines, what is found is what brute force finds, also in blocks of a few lines."""
    lines = templated(random.Random(12), 40)
    frame = line_dedup._lines(docs(list(enumerate(lines))))
    key = {r.line: r.k for r in frame.collect()}
    split = line_dedup.signatures(frame).select(F.lit(1).alias("band"), "k", F.col("k").alias("label"))
    pairs = {(r.a, r.b) for r in line_dedup.all_allowed(split, line_dedup.parities(frame), block=7).collect()}
    want = {tuple(sorted((key[x], key[y]))) for x in lines for y in lines if x < y and similar(x, y)}
    assert want and want <= pairs


@pytest.mark.parametrize(("chars", "edge"), [(27, 1), (75, 4)])
def test_recall_of_signatures(docs, chars, edge):
    """Similar lines share a band about as often as independent MinHashes say."""
    rng = random.Random(13)
    word = lambda n: "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(n))
    lines = [(x, word(edge) + x[edge:-edge] + word(edge)) for x in (word(chars) for _ in range(4000))]
    frame = line_dedup._lines(docs([(0, "\n".join(x for pair in lines for x in pair))]))
    key = {r.line: r.k for r in frame.collect()}
    bands = {r.k: r.bands for r in line_dedup.signatures(frame).select("k", line_dedup.band_hashes().alias("bands")).collect()}
    both, one = chars - 5 - 2 * edge, 2 * edge
    # Two groups of MinHashes must agree, out of GROUPS.
    alike = (both / (both + 2 * one)) ** line_dedup.EACH
    expected = 1 - (1 - alike) ** line_dedup.GROUPS - line_dedup.GROUPS * alike * (1 - alike) ** (line_dedup.GROUPS - 1)
    met = sum(any(p == q for p, q in zip(bands[key[x]], bands[key[y]], strict=True)) for x, y in lines) / len(lines)
    assert expected > 0.96 and met > expected - 0.01


@pytest.mark.parametrize("chars", [30, 120])
def test_recall_just_above_the_threshold(docs, chars):
    """Families of lines of similarity 0.80 to 0.85: what goes is, but for a twentieth, what brute force removes."""
    rng = random.Random(chars)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(60):
        base = word(chars)
        # An edge of e characters replaced: e shingles of one line that the other lacks, and the other way round.
        edge = int((chars - 5) * 0.2 / 1.8)
        lines += [base] + [base[:-edge] + word(edge) if i % 2 else word(edge) + base[edge:] for i in range(9)]
    rng.shuffle(lines)
    pairs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if similar(lines[a], lines[b])]
    root = roots_of(pairs, range(len(lines)))
    want = sum(root[i] != i for i in root)
    found = sum(r.n_removed for r in line_dedup.line_dedup(docs(list(enumerate(lines)))).collect())
    assert want > 400 and 0.95 * want <= found <= want


def test_lines_odd_rows(docs):
    rows = [(3, "a line\n\n a line \nother"), (1, "a line"), (1, "a line"), (2, None), (4, ""), (None, "a line"), (5, "é" * 400 + "\nx"), (6, "😀" * 300 + "\nx")]
    found = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.line_dedup(docs(rows)).collect()]
    want = [(3, "\nother", 2), (1, "a line", 0), (1, "a line", 0), (2, None, 0), (4, "", 0), (None, "", 1), (5, "é" * 400 + "\nx", 0), (6, "😀" * 300, 1)]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert line_dedup.line_dedup(docs([])).count() == 0
    assert line_dedup.line_dedup(docs(rows)).columns[: len(docs([]).columns)] == docs([]).columns


def test_lines_stay_native(docs):
    plan = line_dedup.line_dedup(docs([(1, "a\nb"), (2, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(80)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert found == roots_of(edges, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_of_kept_words(docs):
    row = substring_dedup.substring_dedup(docs([(1, " a\tb ")])).select(F.sha2("kept", 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"a b").hexdigest()


def test_lines_of_documents_with_any_columns(spark):
    rows = [(1, "one line that is here and there", 7, "a", "b", "c", 5, 6), (2, "one line that is here and there\nanother", 8, "a", "b", "c", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc int, doc string, text_key string, gone string, n_lines int, k int")
    found = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert [found[i]["_doc"] for i in (1, 2)] == [7, 8] and found[2].text == "another" and (found[2].doc, found[2].gone, found[2].k) == ("a", "c", 6)
    assert found[2].n_lines == 2 and found[2].n_removed == 1


def test_wide_parities_rule_out_long_lines(docs):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    base = prose(4200)
    lines = [prose(rng.choice((900, 1000, 1100, 2000, 2100, 4000, 9000))) for _ in range(40)] + [base, base[:3000] + "x" + base[3000:], base[150:], base[:2040], base[:2100]]
    frame = line_dedup._lines(docs(list(enumerate(lines))))
    split = line_dedup.signatures(frame).select(F.lit(1).alias("band"), "k", F.col("k").alias("label"))
    keys = {r.line: r.k for r in frame.select("line", "k").collect()}
    found = {(r.a, r.b) for r in line_dedup.all_allowed(split, line_dedup.parities(frame), block=9).collect()}
    sets = {keys[x.strip()]: {x.strip()[i : i + 6] for i in range(len(x.strip()) - 5)} for x in lines}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    # All that are alike stay open, and of some 900 others hardly any.
    assert len(alike) >= 3 and alike <= found and len(found) <= len(alike) + 2


def test_lines_that_share_a_hash_stay(docs, monkeypatch):
    rows = [(1, "first line of all\nsecond one\nthird"), (2, "second one\nfirst line of all\nthird")]
    lines = line_dedup._lines

    def clashing(df, *more):
        return lines(df, *more).withColumn("k", F.when(F.col("line") == "second one", F.xxhash64(F.lit("first line of all"))).otherwise(F.col("k")))

    monkeypatch.setattr(line_dedup, "_lines", clashing)
    found = {r.doc_id: r.text for r in line_dedup.line_dedup(docs(rows)).collect()}
    assert found == {1: "first line of all\nsecond one\nthird", 2: "second one\nfirst line of all"}


def test_lines_make_their_shingles_once(docs):
    """A line is signed without checked products, and its set of shingles is made once for all its bitmaps."""
    frame = line_dedup._lines(docs([(1, "one line of some length\nanother line of some length")]))
    signed = line_dedup.signatures(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert " * " not in signed.replace("(2 * ", "")
    parity = line_dedup.parities(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert parity.count("collect_list(h#") == 1


def test_cut_counts_rows_without_another_job(spark):
    context = spark.sparkContext
    context.setJobGroup("cut-once", "")
    try:
        out = shared.cut(spark.range(1000, numPartitions=40).select("id"), 100)
        assert len(context.statusTracker().getJobIdsForGroup("cut-once")) == 1
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 1000 and out.rdd.getNumPartitions() == max(10, context.defaultParallelism)
    assert shared.cut(spark.range(0), 100).count() == 0
