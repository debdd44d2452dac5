"""Enrichment by stand-in models, and versions of the data model."""

import random
from datetime import datetime

import pytest

from quarry.operators import enrich, versions
from quarry.operators.chunking import ChunkConfig


def test_dimensions():
    assert enrich.dimensions("openai", "text-embedding-3-small", lambda t: [0.0]) == 1536
    assert enrich.dimensions("openai", "unknown", lambda t: [0.0, 1.0]) == 2
    assert enrich.dimensions("openai", "text-embedding-3-small", lambda t: [0.0], 16) == 16


def test_retries():
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise TimeoutError
        return x

    assert enrich.with_retries(flaky, 7, sleep=waits.append) == 7 and len(calls) == 3
    assert 1 <= waits[0] <= 2 and 1 <= waits[1] <= 4
    with pytest.raises(ValueError):
        enrich.with_retries(lambda: (_ for _ in ()).throw(ValueError("bad request")), sleep=waits.append)
    assert len(waits) == 2
    rng = random.Random(1)
    assert all(1000 <= enrich.wait_ms(n, rng) <= min(30_000, 1000 * 2**n) for n in range(1, 9))
    assert enrich.retriable(RuntimeError("HTTP 429")) and not enrich.retriable(RuntimeError("HTTP 400"))
    passing = ("Too Many Requests", "service temporarily unavailable", "internal server error", "connection reset by peer", "request timed out", "rate limit", "status 503")
    assert all(enrich.retriable(RuntimeError(m)) for m in passing)
    for status, passes in ((429, True), (503, True), (404, False)):
        answered = RuntimeError("refused")
        answered.status = status
        wrapped = ValueError("call failed")
        wrapped.__cause__ = answered
        assert enrich.retriable(wrapped) is passes
    assert not any(enrich.retriable(RuntimeError(m)) for m in ("invalid connection string", "model 5000 not found", "unauthorized"))


def test_embeddings(spark):
    chunks = spark.createDataFrame([("u", "b", i, "x" * i) for i in range(5)], "user_id string, bookmark_id string, chunk_index int, chunk_text string")
    rows = enrich.embedded(chunks, lambda texts: [[len(t)] for t in texts], batch=2).collect()
    assert sorted((r.chunk_index, r.embedding) for r in rows) == [(i, [float(i)]) for i in range(5)]
    with pytest.raises(Exception, match="embeddings for"):
        enrich.embedded(chunks, lambda texts: [[1.0]], batch=5).collect()


def test_only_stale_bookmarks_are_analyzed(spark):
    b = spark.createDataFrame([("u", "a", "one two three"), ("u", "b", "four five")], "user_id string, bookmark_id string, text_content string")
    fresh = enrich.chunk_rows(b, ChunkConfig(2, 0))
    assert fresh.count() == 3
    none = fresh.limit(0).selectExpr("user_id", "bookmark_id", "chunk_index", "chunk_hash", "1 AS pipeline_version", "'' AS summary", "array('') AS tags")
    first = enrich.analyzed(fresh, none, lambda t: (t.upper(), [t[0], " "]), 1)
    again = enrich.analyzed(fresh, first.where("bookmark_id = 'a'"), lambda t: ("new", []), 1)
    got = {r.bookmark_id: (r.summaries, r.tags) for r in enrich.consolidated(again).collect()}
    assert got == {"a": ("ONE TWO\nTHREE", ["o", "t"]), "b": ("new", None)}


def test_migrations(spark):
    assert versions.current(spark.createDataFrame([], "version int")) == 0
    steps = [(2, lambda t: t | {"x": 2}), (1, lambda t: t | {"x": 1}), (3, lambda t: t | {"y": t["x"]})]
    assert versions.migrate({}, 1, steps) == ({"x": 2, "y": 2}, 3)
    b = spark.createDataFrame([("u", "https://A.b:443", None), ("u", "https://c.d/", "https://c.d/")], "user_id string, url string, canonical_url string")
    assert sorted(r.canonical_url for r in versions.backfill_canonical_urls(b).collect()) == ["https://a.b/", "https://c.d/"]
    dirty = spark.createDataFrame([([" Rust ", "rust", " "],), ([" "],), (None,)], "tags array<string>")
    assert [r.tags for r in versions.lower_case_tags(dirty).collect()] == [["rust"], None, None]


def test_reset(spark):
    b = spark.createDataFrame([("x" * 250, "s", ["t"]), ("short", "s", None)], "text_content string, summary string, tags array<string>")
    out = versions.reset_derived({"bookmark": b, "bookmark_chunk": b}, datetime(2024, 1, 1))
    assert sorted(r.embedding_status for r in out["bookmark"].collect()) == ["done", "pending"]
    assert out["bookmark_chunk"].count() == 0 and out["bookmark"].where("summary is null and tags is null").count() == 2


def test_sign_up_rules(spark):
    rows = [("a", "long enough", "long enough"), (" ", "short", "other"), ("a", "        ", "        ")]
    found = versions.sign_up_errors(spark.createDataFrame(rows, "username string, password string, confirmation string")).collect()
    errors = {r.username + r.password: [tuple(e) for e in r.errors] for r in found}
    assert errors["along enough"] == []
    assert [f for f, _ in errors[" short"]] == ["username", "password", "password"]
    assert errors["a        "] == [("password", "password must not be empty")]
