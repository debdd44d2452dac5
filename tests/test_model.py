"""Tags, URLs, vectors, fusion, chunks, queues, limits and table changes over literal cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import markup as M
from quarry.functions.stem import stem
from quarry.functions.urls import bookmark_id, canonical_url, domain, murmur3_128
from quarry.operators import chunking, fusion, history, limiter, mutations, predicates, queues, tags, vector
from quarry.operators.rag import NO_ANSWER, UNASSESSED, Hybrid, RagEngine

NOW = datetime(2024, 1, 1)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "expected"),
    [([" Rust ", "rust", "   ", "", " SQL "], ["rust", "sql"]), ([" New ", "new"], ["new"]), (["", " "], None), ([], None), (None, None)],
)
def test_normalized_tags(spark, raw, expected):
    assert one(spark, tags.normalized("t"), t=("array<string>", raw)) == expected


def test_appended_tags(spark):
    assert sorted(one(spark, tags.appended("o", "n"), o=("array<string>", ["Initial", "existing"]), n=("array<string>", ["new", " New", "existing"]))) == ["Initial", "existing", "new"]
    assert one(spark, tags.appended("o", "n"), o=("array<string>", None), n=("array<string>", [" "])) is None
    assert one(spark, tags.listed("t"), t=("string", "b, a,,b ")) == ["a", "b"]
    assert one(spark, tags.without_blanks("t"), t=("array<string>", [" A", "", " "])) == [" A"]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://EXAMPLE.com:8443/post?a=1&b=2#section", "https://example.com:8443/post?a=1&b=2"),
        ("https://EXAMPLE.com:443/post#section", "https://example.com/post"),
        ("HTTP://a.b:80", "http://a.b/"),
        ("http://a.b:443/", "http://a.b:443/"),
        ("https://a.b?q", "https://a.b/?q"),
        ("mailto:x@y", None),
        ("not a url", None),
        ("https:///path", None),
        (None, None),
    ],
)
def test_canonical_urls(spark, url, expected):
    assert one(spark, canonical_url("u"), u=("string", url)) == expected


def test_domain_and_id(spark):
    assert one(spark, domain("u"), u=("string", "https://WWW.a.b:99/x")) == "www.a.b"
    assert len(one(spark, bookmark_id("u"), u=("string", "https://a.b/"))) == 22
    # Published test value of the 128-bit x64 variant.
    h = int.from_bytes(murmur3_128(b"The quick brown fox jumps over the lazy dog"), "big")
    assert (h & (1 << 64) - 1, h >> 64) == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)


def test_byte_and_character_gates_differ(spark):
    df = spark.createDataFrame([("é" * 150,)], "text_content string")
    assert df.where(predicates.long_enough()).count() == 0
    assert df.where(predicates.long_enough(unit="bytes")).count() == 1


def test_cosine(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [-1.0, 0.0]), ("d", [1.0, 1.0]), ("e", [1.0, 0.0, 0.0])]
    c = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    found = [(r.chunk_id, round(r.similarity, 3)) for r in vector.nearest(c, [2.0, 0.0], 10).collect()]
    assert found == [("a", 1.0), ("d", 0.707), ("c", -1.0)]
    assert [r.chunk_id for r in vector.nearest(c, [2.0, 0.0], 10, 0.99).collect()] == ["a"]
    with pytest.raises(ValueError):
        vector.check_dimensions(c)
    with pytest.raises(ValueError):
        vector.check_dimensions(c.limit(2), 1)
    assert [vector.profile_change(*a) for a in ((("p", "m", 3), ("p", "m", 3), True), (None, ("p", "m", 3), False), (None, ("p", "m", 3), True), (("q", "m", 3), ("p", "m", 3), False))] == ["keep", "store", "reset", "reset"]


def test_hybrid_ranks(spark):
    v = spark.createDataFrame([("b1", "c1", 0.9), ("b2", "c2", 0.8), ("b3", "c3", 0.7)], "bookmark_id string, chunk_id string, similarity double")
    t = spark.createDataFrame([("b2", 5.0), ("x", 4.0), ("y", 3.0), ("z", 2.0), ("b3", 1.0)], "bookmark_id string, rank double")
    rows = {r.chunk_id: r for r in fusion.hybrid(v, t, 3).withColumn("rrf", fusion.rrf()).collect()}
    assert [rows[c].fts_rank for c in ("c1", "c2", "c3")] == [4, 1, 5]  # a late hit ranks behind none
    assert rows["c1"].rrf == pytest.approx(1 / 61 + 1 / 64)


@pytest.mark.parametrize("weights", [(0, 0), (-0.1, 1), (float("nan"), 1)])
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        Hybrid(True, False, 60, *weights).check()


def test_good_weights():
    Hybrid(True, False, 60, 0.2, 0.8).check()
    Hybrid(True, True, 60, 0, 0).check()


def test_merging(spark):
    m = spark.createDataFrame([("c", 0.9, 0, 1), ("c", 0.9, 1, 1), ("d", 0.8, 0, 2), ("c", 0.7, 1, 2)], "chunk_id string, similarity double, qpos int, pos int")
    assert [r.chunk_id for r in fusion.merge_matches(m).orderBy("rank").collect()] == ["c", "d", "c"]
    assert [r.chunk_id for r in fusion.merge_matches(m, mode="global").orderBy("rank").collect()] == ["c", "d"]


@pytest.mark.parametrize(("tokens", "most", "kept"), [([5000], 4096, 0), ([3896], 4096, 1), ([3000, 1000, 10], 4096, 1), ([1], 100, 0)])
def test_budget_stops_at_the_first_overflow(spark, tokens, most, kept):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "rank int, tokens int")
    assert fusion.within_budget(df, most).count() == kept


@pytest.mark.parametrize(("n", "size", "overlap", "expected"), [(0, 3, 1, []), (2, 3, 1, ["0 1"]), (3, 3, 1, ["0 1 2", "2"]), (7, 3, 1, ["0 1 2", "2 3 4", "4 5 6", "6"]), (4, 2, 0, ["0 1", "2 3"])])
def test_windows(spark, n, size, overlap, expected):
    df = spark.createDataFrame([("b", " ".join(map(str, range(n))))], "bookmark_id string, text_content string")
    rows = chunking.windows(df, chunking.ChunkConfig(size, overlap)).orderBy("chunk_index").collect()
    assert [r.chunk_text for r in rows] == expected
    whole = chunking.windows(df, chunking.ChunkConfig(size, overlap), keep_partial=False)
    assert all(len(r.chunk_text.split()) == min(n, size) for r in whole.collect())


def test_bad_chunk_configs():
    for size, overlap in ((0, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            chunking.ChunkConfig(size, overlap)
    assert chunking.ChunkConfig.of("ollama") == chunking.ChunkConfig(1000, 100)


def test_cache_validity(spark):
    fresh = spark.createDataFrame([("u", "a", 0, "h"), ("u", "b", 0, "h"), ("u", "c", 0, "h")], "user_id string, bookmark_id string, chunk_index int, chunk_hash string")
    stored = spark.createDataFrame([("u", "a", 0, "h", 2), ("u", "b", 0, "h", 2), ("u", "b", 1, "h", 2), ("u", "c", 0, "h", 1)], "user_id string, bookmark_id string, chunk_index int, chunk_hash string, pipeline_version int")
    assert {r.bookmark_id: r.valid for r in chunking.cache_validity(fresh, stored, 2).collect()} == {"a": True, "b": False, "c": False}


def tasks(spark, n, at=NOW):
    rows = [(f"t{i:03}", "u", "pending", at, at, 0) for i in range(n)]
    return spark.createDataFrame(rows, "task_id string, user_id string, status string, created_at timestamp, next_delivery timestamp, retries int")


def test_claims_lease_and_come_back(spark):
    t = tasks(spark, 3)
    first, t = queues.claim_tasks(t, NOW)
    second, t = queues.claim_tasks(t, NOW)
    third, _ = queues.claim_tasks(t, NOW + timedelta(minutes=6))
    assert [first.count(), second.count(), third.count()] == [3, 0, 3]
    assert queues.claim_tasks(tasks(spark, 15), NOW)[0].count() == 10


def test_claims_are_disjoint(spark):
    a, rest = queues.claim_tasks(tasks(spark, 5), NOW, 3)
    b, _ = queues.claim_tasks(rest, NOW, 3)
    names = [{r.task_id for r in x.collect()} for x in (a, b)]
    assert not names[0] & names[1] and len(names[0] | names[1]) == 5


@pytest.mark.parametrize(("retries", "status", "left"), [(None, "pending", 1), (4, "pending", 5), (5, "fail", None)])
def test_task_failures(spark, retries, status, left):
    df = spark.createDataFrame([("t", retries)], "task_id string, retries int")
    row = queues.task_outcome(df, F.lit(True), F.lit("why")).first()
    assert (row.status, row.retries, row.fail_reason) == (status, left, "why" if status == "fail" else None)
    assert queues.task_outcome(df, F.lit(False), F.lit("why")).first().status == "done"


@pytest.mark.parametrize(("before", "minutes", "status"), [(0, 5, "pending"), (1, 15, "pending"), (2, 60, "pending"), (3, 360, "pending"), (4, 0, "fail")])
def test_backoff(spark, before, minutes, status):
    df = spark.createDataFrame([(before,)], "text_ai_attempts int")
    row = queues.ai_failure(df, "text_ai", NOW, F.lit("r" * 3000)).first()
    assert row.text_ai_next_attempt_at == NOW + timedelta(minutes=minutes) and row.text_ai_status == status
    assert len(row.text_ai_fail_reason) == 2048


def test_text_ai_claims(spark):
    b = spark.createDataFrame([("u", "tagged", "x" * 250, ["a"], None, NOW), ("u", "empty", "short", [], None, NOW), ("u", "null", None, None, "s", NOW)], "user_id string, bookmark_id string, text_content string, tags array<string>, summary string, created_at timestamp")
    b = queues.initial_status(b)
    state = {r.bookmark_id: r for r in b.collect()}
    assert state["tagged"].embedding_status == "pending" and state["empty"].embedding_status == "done"
    b = b.withColumns({"text_ai_next_attempt_at": F.lit(NOW), "text_ai_attempts": F.lit(0)})
    claimed, leased = queues.claim_ai(b, "text_ai", NOW)
    needs = {r.bookmark_id: (r.needs_summary, r.needs_tags) for r in claimed.collect()}
    assert needs == {"tagged": (True, False), "empty": (True, True), "null": (False, True)}
    assert queues.claim_ai(leased, "text_ai", NOW)[0].count() == 0
    assert queues.ai_success(leased, "text_ai", 3).where("text_ai_status = 'done' AND tag_status = 'done'").count() == 3


def test_limiter(spark):
    times = [("k", i, float(t), s) for i, (t, s) in enumerate([(0, False), (1, False), (2, False), (59.5, False), (60, False), (61, True), (62, False), (62, False)])]
    df = spark.createDataFrame(times, "key string, seq long, at double, success boolean")
    rows = limiter.decisions(df, 2, 60).orderBy("seq").collect()
    assert [r.allowed for r in rows] == [True, True, False, False, True, True, True, True]
    assert [r.retry_after for r in rows][2:4] == [58, 1]


def test_pacing(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([0.0, 0.0, 0.0, 10.0])], "i int, t double")
    assert [r.release for r in queues.pacing(df, "t", 2.0, order=("i",)).orderBy("i").collect()] == [0.0, 2.0, 4.0, 10.0]


def test_new_bookmarks(spark):
    columns = "user_id string, url string, tags array<string>, created_at timestamp"
    old = spark.createDataFrame([("u", "https://example.com/duplicate?a=1", None, NOW)], columns)
    rows = [("u", "https://EXAMPLE.com:443/duplicate?a=1#top", None), ("v", "https://EXAMPLE.com:443/duplicate?a=1#top", [" A "]), ("u", "https://example.com/?a=2", None), ("u", "https://example.com/?a=2#x", None), ("u", "nonsense", None)]
    new = spark.createDataFrame([(u, x, t, NOW + timedelta(seconds=i)) for i, (u, x, t) in enumerate(rows)], columns)
    accepted, refused = mutations.new_bookmarks(old, new)
    assert sorted((r.user_id, r.url) for r in accepted.collect()) == [("u", "https://example.com/?a=2"), ("v", "https://EXAMPLE.com:443/duplicate?a=1#top")]
    assert refused.count() == 3
    with pytest.raises(mutations.DuplicateError):
        mutations.check_collisions(new)
    mutations.check_collisions(accepted)


def test_updates_and_deletes(spark):
    b = queues.initial_status(spark.createDataFrame([("u", "1", ["initial"], None, "t"), ("u", "2", None, "s", "t")], "user_id string, bookmark_id string, tags array<string>, summary string, text_content string"))
    change = spark.createDataFrame([("u", "1", ["rust", "Programming"])], "user_id string, bookmark_id string, new_tags array<string>")
    got = {r.bookmark_id: r for r in mutations.update_tags(b, change).collect()}
    assert got["1"].tags == ["rust", "programming"] and got["1"].tag_status == "done" and got["2"].tags is None
    blank = spark.createDataFrame([("u", "2", "  ")], "user_id string, bookmark_id string, new_summary string")
    got = {r.bookmark_id: r for r in mutations.update_summary(b, blank).collect()}
    assert got["2"].summary is None and got["2"].summary_status == "pending"
    c = spark.createDataFrame([("u", "1", 0), ("u", "2", 0)], "user_id string, bookmark_id string, chunk_index int")
    left = mutations.delete_cascade({"b": b, "c": c}, b.where("bookmark_id = '1'"), ["user_id", "bookmark_id"])
    assert [left["b"].count(), left["c"].count()] == [1, 1]
    assert mutations.upsert(c, c.where("bookmark_id = '1'").withColumn("chunk_index", F.lit(9)), ["user_id", "bookmark_id"]).where("chunk_index = 9").count() == 1


def test_ai_output(spark):
    rows = [("s", ["t"], " ", ["N "], True, True, True), ("s", ["t"], "n", ["n"], False, False, True), ("s", ["t"], "n", ["n"], True, True, False)]
    df = spark.createDataFrame(rows, "summary string, tags array<string>, new_summary string, new_tags array<string>, needs_summary boolean, needs_tags boolean, has_chunks boolean")
    assert [(r.summary, r.tags) for r in mutations.ai_output(df).collect()] == [(None, ["n"]), ("s", ["t"]), ("s", ["t"])]


def test_history(spark):
    s = spark.createDataFrame([("1", ["c2", "gone", "c1", "c2"]), ("2", [])], "session_id string, relevant_chunks array<string>")
    c = spark.createDataFrame([("c1", "b", 0), ("c2", "b", 1)], "chunk_id string, bookmark_id string, chunk_index int")
    got = {r.session_id: [x.chunk_id for x in r.sources] for r in history.with_sources(s, c).collect()}
    assert got == {"1": ["c2", "c1", "c2"], "2": []}


def test_answers(spark):
    chunks = spark.createDataFrame([("c1", "b", "u", "first chunk", 0, [1.0, 0.0]), ("c2", "b", "u", "second chunk", 1, [0.8, 0.6]), ("c3", "b", "v", "foreign", 0, [1.0, 0.0])], "chunk_id string, bookmark_id string, user_id string, chunk_text string, chunk_index int, embedding array<float>")
    b = spark.createDataFrame([("u", "b", "first", "second", None)], "user_id string, bookmark_id string, title string, text_content string, tags array<string>")
    engine = RagEngine(embed=lambda q: [1.0, 0.0], expand=lambda q: ["variant"])
    row = engine.ask(b, chunks, "u", "what?", NOW)
    assert row["relevant_chunks"] == ["c1", "c2"] and row["answer"] == "first chunk\n\nsecond chunk"
    assert RagEngine(embed=lambda q: [0.0, -1.0]).ask(b, chunks, "u", "what?", NOW)["answer"] == NO_ANSWER

    def judge(question, text):
        if "first" in text:
            raise RuntimeError
        return False, "no"

    kept = RagEngine(embed=lambda q: [1.0, 0.0], relevant=judge).retrieve(b, chunks, "u", "what?").collect()
    assert [(r.chunk_id, r.why) for r in kept] == [("c1", UNASSESSED)]
    assert {"bookmark_id", "chunk_index"} <= set(kept[0].asDict())
    hybrid = RagEngine(embed=lambda q: [1.0, 0.0], hybrid=Hybrid(True)).ask(b, chunks, "u", "first", NOW)
    assert hybrid["relevant_chunks"] == ["c1", "c2"]


def test_html(spark):
    page = "<html><head><title>A &amp; B</title><script>var x='<p>'</script></head><body><nav>menu</nav><article><h1>Head</h1><p onclick='x()'>Text&nbsp;here <img src='/i.png'></p><blink>old</blink></article></body></html>"
    assert one(spark, H.title("h"), h=("string", page)) == "A & B"
    assert one(spark, M.article_text("h"), h=("string", page)) == "Head Text here old"
    clean = one(spark, M.sanitized("h"), h=("string", page))
    assert "onclick" not in clean and "<blink>" not in clean and "script" not in clean and "<p>" in clean
    assert one(spark, H.image_sources("h"), h=("string", page)) == ["/i.png"]
    for src, url in (("/i.png", "https://a.b/i.png"), ("i.png", "https://a.b/c/i.png"), ("//x.y/i", "https://x.y/i"), ("http://q/i", "http://q/i"), ("data:abc", None), ("", None)):
        assert one(spark, H.absolute(F.col("s"), F.col("u")), s=("string", src), u=("string", "https://a.b/c/d?e")) == url


def test_nested_and_broken_markup(spark):
    menu = "<div class='m'>" + "".join(f"<a href='/{i}'>Link number {i}</a> " for i in range(40)) + "</div>"
    inner = "<div><p>First <b>paragraph, of some length.</b></p><div><article><p>Nested article part.</p></article></div><p>Second paragraph &lt;kept&gt;, after the nested one."
    page = f"<body>{menu}<div id='x'>{inner}</div><div>short</div></body>"
    text = one(spark, M.article_text("h"), h=("string", page))
    assert text == "First paragraph, of some length. Nested article part. Second paragraph <kept>, after the nested one."
    assert one(spark, M.article_text("h"), h=("string", None)) is None
    assert one(spark, M.article_text("h"), h=("string", "")) == ""
    assert one(spark, M.article_text("h"), h=("string", "<div>" * 2000 + "deep")) == "deep"


@pytest.mark.parametrize(
    ("markup", "clean"),
    [
        ("<p onclick=x>a</p>", "<p>a</p>"),
        ("<a href='javascript:x()'>a</a>", "<a>a</a>"),
        ("<a href=' java\tscript:x()'>a</a>", "<a>a</a>"),
        ("<a href='/x?a=1&amp;b=2' target=_top>a</a>", '<a href="/x?a=1&amp;b=2">a</a>'),
        ("<img src=x onerror=y alt='a>b'>", '<img src="x" alt="a&gt;b">'),
        ("<scr<script>ipt>alert(1)</script>x", "ipt&gt;alert(1)x"),
        ("<script>alert('<p>')</script><p>x", "<p>x</p>"),
        ("<blink><b>x</blink>y", "<b>x</b>y"),
        ("a < b & c", "a &lt; b &amp; c"),
        ("<svg><p>x</p></svg>y", "y"),
        ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
    ],
)
def test_sanitized(spark, markup, clean):
    assert one(spark, M.sanitized("h"), h=("string", markup)) == clean


@pytest.mark.parametrize("line", "consistency>consist knavish>knavish generically>generic hopping>hop hoping>hope relational>relat sensibilities>sensibl ties>tie cries>cri gas>gas kiwis>kiwi enjoying>enjoy skies>sky news>news agreed>agre replacement>replac controlling>control by>by electrical>electr universities>univers".split())
def test_stems(line):
    word, want = line.split(">")
    assert stem(word) == want


def test_inverted_lists_recall(spark):
    import random

    rng = random.Random(5)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(str(i), [c + rng.gauss(0, 0.4) for c in centers[i % 12]]) for i in range(1500)] + [("none", None), ("zero", [0.0] * 8)]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    index = vector.InvertedLists.fit(chunks, 12)
    table = index.assigned(chunks).cache()
    assert table.where("cell is null").count() == 1 and table.count() == len(rows)
    found = wanted = 0
    for i in range(0, 1500, 300):
        exact = {r.chunk_id for r in vector.nearest(chunks, rows[i][1], 10).collect()}
        near = {r.chunk_id for r in index.nearest(table, rows[i][1], 10, probes=3).collect()}
        found, wanted = found + len(exact & near), wanted + len(exact)
    assert found >= 0.9 * wanted == 45


def test_batches_of_queries_in_blocks(spark):
    chunks = spark.createDataFrame([(str(i), [float(i % 7), 1.0], f"t{i}") for i in range(60)], "chunk_id string, embedding array<float>, chunk_text string")
    queries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "query_id int, query array<float>")
    rows = lambda most: sorted((r.query_id, r.rank, r.chunk_id, r.chunk_text) for r in vector.nearest_batch(chunks, queries, 3, most=most).collect())
    assert rows(2) == rows(100) and len(rows(2)) == 27
