import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import fts, headline, index, rank

WORDS = "the of a thing things rust safety program programming web tutorial guide system language test".split()


@pytest.fixture(scope="module")
def bookmarks(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choices(WORDS, k=rng.randrange(n))) + rng.choice(["", ".", " x-y!"])
    rows = [(str(i), rng.choice(["u", "v"]), text(6), text(120), rng.choice([None, [], ["rust"], ["web", "guide"]])) for i in range(300)]
    rows += [("300", "u", None, None, None), ("301", "u", "", "", []), ("302", "v", "the", "the " * 3000, ["the"])]
    df = spark.createDataFrame(rows, "bookmark_id string, user_id string, title string, text_content string, tags array<string>")
    return df.cache()


QUERIES = ["rust", "rust programming", '"rust programming"', "rust or web", "the of -rust", "-the", '"the of" or "rust web" -guide', '"the" or things', "the or of or a or thing", "nothere", "rust nothere", '"safety program" test', "thing", '"rust the web"']


@pytest.fixture(scope="module", params=["simple", "english"])
def stored(spark, bookmarks, request):
    name = f"index_{uuid.uuid4().hex}"
    index.write(index.build(bookmarks, request.param, block_docs=20), name, 4)
    yield request.param, spark.table(name)
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("text", QUERIES)
def test_index_finds_and_ranks_as_a_scan(bookmarks, stored, text):
    language, table = stored
    query = fts.web_query(text, language)
    for user in ("u", "v"):
        scan = fts.search(fts.search_columns(bookmarks.where(F.col("user_id") == user), language), query)
        want = {r["bookmark_id"]: r["rank"] for r in scan.select("bookmark_id", "rank").collect()}
        got = {r["bookmark_id"]: r["rank"] for r in index.search(table, query, user).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[b], want[b], rel_tol=1e-6, abs_tol=1e-12) for b in want)
        # The best of the blocks that bounds leave over are the best of all.
        best = sorted(got.items(), key=lambda x: (-x[1], x[0]))[:5]
        found = [(r["bookmark_id"], r["rank"]) for r in index.top(table, query, user, 5, first=1).collect()]
        assert [round(s, 9) for _, s in found] == [round(s, 9) for _, s in best]
        assert {b for b, s in found if s > best[-1][1] + 1e-9} == {b for b, s in best if s > best[-1][1] + 1e-9}


def test_plan_reads_only_the_words_of_the_query(spark, stored):
    language, table = stored
    found = index.search(table, fts.web_query('"rust web" or guide', language), "u")
    plan = found._jdf.queryExecution().toString()
    assert "text_content" not in plan and "SelectedBucketsCount" in plan and "lexeme" in plan


def test_page_joins_only_the_best(bookmarks, stored):
    language, table = stored
    rows = index.page(table, fts.web_query("rust or web", language), "u", bookmarks, 4).select("bookmark_id", "rank", "title", "place").collect()
    assert [r["place"] for r in rows] == [1, 2, 3, 4] and [r["rank"] for r in rows] == sorted((r["rank"] for r in rows), reverse=True)


def plain_proximity(terms):
    none, met = 1.0, False
    for i, (a, wa) in enumerate(terms):
        for b, wb in terms[:i]:
            for p, x in zip(a, wa, strict=True):
                for q, y in zip(b, wb, strict=True):
                    if p != q:
                        d = abs(p - q)
                        none *= 1 - math.sqrt(x * y * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
                        met = True
    return max(1 - none, 1e-20) if met else 1e-20


def test_proximity_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        terms = [(np.sort(rng.choice(900, rng.integers(0, 12), replace=False)), None) for _ in range(rng.integers(1, 4))]
        terms = [(at, rng.choice([0.1, 0.2, 0.4, 1.0], len(at))) for at, _ in terms]
        assert math.isclose(rank.proximity_of(terms), plain_proximity([(a.tolist(), w.tolist()) for a, w in terms]), rel_tol=1e-6, abs_tol=1e-13)


def test_nearer_terms_and_heavier_parts_rank_higher(spark):
    def ranks(query, *rows):
        df = spark.createDataFrame([(str(i), "u", *r, None) for i, r in enumerate(rows)], "bookmark_id string, user_id string, title string, text_content string, tags array<string>")
        found = fts.search(fts.search_columns(df), fts.web_query(query)).orderBy("bookmark_id").collect()
        return [r["rank"] for r in found]

    near, far = ranks("rust safety", ("t", "rust safety " + "word " * 30), ("t", "rust " + "word " * 30 + "safety"))
    assert near > far > 0
    title, body = ranks("rust", ("rust", "x"), ("x", "rust"))
    assert math.isclose(title, 1 / rank.SQUARES) and math.isclose(body, 0.4 / rank.SQUARES)
    once, twice = ranks("rust", ("x", "rust"), ("x", "rust rust"))
    assert math.isclose(twice - once, 0.4 / 4 / rank.SQUARES)
    # Excluded words take no part; words that stand at one place only do not meet.
    assert ranks("rust -web", ("rust", "x")) == ranks("rust", ("rust", "x")) and ranks("-web", ("rust", "x")) == [0.0]
    assert rank.proximity_of([(np.array([3]), np.array([1.0])), (np.array([3]), np.array([1.0]))]) == rank.LOWEST


@pytest.mark.parametrize(("flags", "divisor"), [(1, math.log2(9)), (2, 8), (8, 4), (16, math.log2(5)), (32, None)])
def test_length_normalisation(spark, flags, divisor):
    got = spark.range(1).select(rank.normalized(F.lit(0.5), F.lit(8), F.lit(4), flags).alias("r")).first()["r"]
    assert math.isclose(got, 0.5 / divisor if divisor else 0.5 / 1.5)


def shown(text, query, language="english", most=35, least=15):
    groups = [[c.lexemes(language) for c in g if not c.negated] for g in fts.web_query(query, language).groups]
    return headline.marked(text, [g for g in groups if g], language != "simple", most, least)


def test_highlights():
    article = "This article discusses the importance of testing and debugging in software development"
    assert shown(article, "testing") == "<mark>testing</mark> and debugging in software development".join(["This article discusses the importance of ", ""])
    # Both words of a conjunction, though one of them comes earlier alone.
    text = "rust " + "word " * 40 + "safe rust, here: safety! " + "more " * 40
    assert "<mark>rust</mark>, here: <mark>safety</mark>!" in shown(text, "rust safety", "simple")
    # A phrase is a cover only where its words follow one another.
    text = "new york " + "pad " * 50 + "york new " + "pad " * 50 + "in new york city " + "pad " * 20
    assert shown(text, '"york new"', "simple").startswith("<mark>york</mark> <mark>new</mark>")
    assert shown("one two three", "zzz", "simple", least=2) == "one two"
    assert shown("", "x") == "" and shown(" ... ", "x") == ""


def test_fragments_keep_their_bounds():
    rng = random.Random(9)
    for _ in range(200):
        words = rng.choices(["ab", "long", "words", "hit", "other", "x"], k=rng.randrange(1, 120))
        text = " ".join(words)
        got = shown(text, rng.choice(["hit", "hit other", '"hit other" or x', "hit or other"]), "simple")
        n = len(got.split())
        assert n <= 35 and (n >= 15 or n == len(words))
        assert got.replace("<mark>", "").replace("</mark>", "") in text


def test_covers_are_the_shortest_runs():
    rng = random.Random(4)
    for _ in range(200):
        words = rng.choices("abcd", k=rng.randrange(0, 25))
        group = [list(x) for x in rng.sample(["a", "b", "ab", "bc", "d"], 2)]

        def holds(i, j, words=words, group=group):
            return all(any(words[k : k + len(p)] == p for k in range(i, j - len(p) + 2)) for p in group)

        runs = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if holds(i, j)]
        least = [(i, j) for i, j in runs if not any((x, y) != (i, j) and i <= x and y <= j for x, y in runs)]
        assert headline.covers(words, [group]) == sorted(least)


def test_headline_column(spark):
    df = spark.createDataFrame([(1, "A Thing, of course"), (2, None), (3, "")], "id int, t string")
    got = [r["h"] for r in df.select("id", headline.headline("t", fts.web_query("things")).alias("h")).orderBy("id").collect()]
    assert got == ["A <mark>Thing</mark>, of course", None, ""]


def test_documents_are_built_in_blocks_without_a_shuffle_of_words(spark, bookmarks):
    plan = index.build(bookmarks, "simple")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "ObjectHashAggregate" not in plan and "SortMergeJoin" not in plan


def test_index_keeps_rows_of_equal_ids_apart(spark):
    rows = [("1", "u", "rust", "safe rust", ["web"]), ("1", "u", None, "rust in a web", None), ("1", "v", "", "rust", []), (None, None, "x", "no rust", None), ("2", "u", "web", None, ["the"])]
    df = spark.createDataFrame(rows, "bookmark_id string, user_id string, title string, text_content string, tags array<string>")
    for text in ("rust", "rust web", "-safe", "web or in", '"safe rust"'):
        query = fts.web_query(text, "simple")
        scan = [(r["bookmark_id"], round(r["rank"], 9)) for r in fts.search(fts.search_columns(df, "simple"), query).collect()]
        for block_docs in (1, 100):
            got = [(r["bookmark_id"], round(r["rank"], 9)) for r in index.search(index.build(df, "simple", block_docs), query, None).collect()]
            assert sorted(got, key=str) == sorted(scan, key=str)
    nothing = index.search(index.build(df.limit(0), "simple"), fts.web_query("rust", "simple"), None)
    assert nothing.collect() == []


def test_postings_join_rows_of_one_bookmark(spark):
    rows = [("1", "u", "a b a", "b", ["c"]), ("1", "u", "b", None, None), ("2", "u", None, "", [])]
    df = spark.createDataFrame(rows, "bookmark_id string, user_id string, title string, text_content string, tags array<string>")
    found = fts.postings(df, "simple")
    got = {(r["lexeme"], r["weight"], r["user_id"], r["bookmark_id"]): r["positions"] for r in found.collect()}
    assert got == {("a", "A", "u", "1"): [0, 2], ("b", "A", "u", "1"): [0, 1], ("b", "B", "u", "1"): [0], ("c", "C", "u", "1"): [0]}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_scan_ranks_by_counts_of_words(spark, bookmarks):
    """No step per word and place: lexemes are counted, and only the hits get weights."""
    found = fts.search(fts.search_columns(bookmarks, "simple"), fts.web_query("rust or web", "simple")).select("bookmark_id", "rank")
    assert "array_remove(text_lexemes" in found._jdf.queryExecution().executedPlan().toString()
    got = {r["bookmark_id"]: r["rank"] for r in found.collect()}
    for r in bookmarks.where("bookmark_id in ('1', '7', '20', '33')").collect():
        want = 0.0
        for term in ("rust", "web"):
            weights = [w for text, w in ((r["title"], 1.0), (r["text_content"], 0.4), (" ".join(r["tags"] or []), 0.2)) for x in fts.re.split(r"[\W_]+", text or "") if x == term]
            want += sum(w / (i + 1) ** 2 for i, w in enumerate(weights)) / rank.SQUARES / 2
        assert math.isclose(got.get(r["bookmark_id"], 0.0), want, abs_tol=1e-12)
