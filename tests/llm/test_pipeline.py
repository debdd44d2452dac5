"""The pipeline's stages on small tables, each held against what it promises."""

from collections import Counter

import pytest

import corpus_pipeline
from quarry.llm import ngram_jaccard, source_mix, toxicity
from quarry.llm.shared import cut, possible, table

from .conftest import words
from .test_text_operators import corpus, roots_of, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic rows, copies, nulls and ties."""
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in corpus(11)]
    toxic = [(1000 + i, f"{t} you stupid idiot", "en", "src1", 0) for i, (_, t) in enumerate(corpus(12, 80))]
    odd = [(2000, None, None, None, None), (2001, "", "en", None, 0), (2002, "same text " * 10, "en", "src0", 0), (2002, "same text " * 10, "en", "src0", 0)]
    spark.createDataFrame(rows + toxic + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows] + [(r[0], 1, 1) for r in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_are_declared():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "lines", "near_duplicates", "mix", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(spark, folder):
    docs = table(spark, folder, "documents")
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == COLUMNS
    ids = Counter(r.doc_id for r in kept.collect())
    assert not any(1000 <= i < 2000 for i in ids)
    assert ids == Counter(r.doc_id for r in docs.collect() if not 1000 <= r.doc_id < 2000)
    scores = toxicity.toxicity_scores(docs, toxicity.train(docs, table(spark, folder, "labels")))
    assert scores.where("predicted = 0").count() == sum(ids.values())


def test_lines_go_and_documents_stay(spark, folder):
    docs = table(spark, folder, "documents")
    kept = corpus_pipeline.drop_repeated_lines(spark, docs, folder)
    assert kept.columns == COLUMNS and kept.count() == docs.count()
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in kept.collect())


def test_one_of_each_group_stays(spark, folder):
    docs = table(spark, folder, "documents")
    rows = docs.collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0]
    want = roots_of(pairs, sets)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert kept.columns == COLUMNS
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if want[r.doc_id] == r.doc_id)
    assert ngram_jaccard.ngram_jaccard(docs).count() == len(rows)


def test_the_mix_is_what_the_schedule_takes(spark, folder):
    docs = table(spark, folder, "documents")
    plan = Counter()
    for r in source_mix.mix_sources(docs).collect():
        plan[r.doc_id] += r.taken
    mixed = corpus_pipeline.mix(spark, docs, folder)
    assert mixed.columns == COLUMNS
    got, originals = Counter(), {r.doc_id: words(r.text) for r in docs.collect()}
    for r in mixed.collect():
        w = words(r.text)
        assert w and w == originals[r.doc_id][: len(w)] and r.n_chars == len(r.text)
        got[r.doc_id] += len(w)
    assert got == Counter({i: n for i, n in plan.items() if n})


def test_run_of_all_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r.n_tokens == len(r.ids) > 0 for r in rows)
    # The stages one by one, as a driver would write and reread them, give the same.
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert Counter((r.doc_id, r.ids_sha256) for r in docs.collect()) == Counter((r.doc_id, r.ids_sha256) for r in rows)


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_and_null_tables(spark, folder, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = table(spark, folder, "documents")
    assert run(spark, docs.limit(0), folder).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (None, "a b", None, None, None), (2, "", None, None, 0)], docs.schema)
    # Only the mix leaves out rows without words.
    assert run(spark, nulls, folder).count() == (1 if stage == "mix" else 4)


def test_long_texts_pass_all_stages(spark, folder):
    """A text of a megabyte in one line and one in many lines, beside short ones."""
    docs = table(spark, folder, "documents")
    one, many = " ".join(f"w{i % 5000}x{i}" for i in range(90_000)), "\n".join(f"line {i} of the long text" for i in range(40_000))
    long = spark.createDataFrame([(5000, one, "en", "src0", len(one)), (5001, many, "en", "src1", len(many)), (5002, one + " end", "en", "src1", 0)], docs.schema)
    found = long
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, found, folder)
        if name != "tokens":
            found = cut(found)
        if name == "lines":
            kept = {r.doc_id: r.text for r in found.collect()}
            # Either long line may give way to the other; numbered lines resemble one another.
            assert one in (kept[5000], kept[5000] + kept[5002][: len(one)]) and kept[5001].startswith("line 0 of")
        if name == "near_duplicates":
            assert {5000, 5001} <= {r.doc_id for r in found.collect()}
    assert all(r.n_tokens > 0 for r in found.collect())


def test_the_map_of_keys_loses_none(spark):
    df = spark.range(20_000).selectExpr("id * 7919 - 5000 AS k", "id AS x")
    keys = df.where("x % 10 = 3").select("k")
    found = {r.k for r in possible(df, keys, "k").collect()}
    assert {r.k for r in keys.collect()} <= found and len(found) < 4000
    assert possible(df, keys.limit(0), "k").count() == 0
