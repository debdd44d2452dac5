"""Readers, sinks and streams over small files."""

import json
from datetime import datetime

import pytest

from quarry.operators import fts
from quarry.sources import readers, sinks
from quarry.streaming import queue_stream


def test_url_lists(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("https://a.b/1\n\n  https://a.b/2 \n")
    urls = readers.url_lines(spark, str(tmp_path / "urls.txt"))
    assert sorted(r.url for r in readers.check_urls(urls).collect()) == ["https://a.b/1", "https://a.b/2"]
    done = spark.createDataFrame([("https://a.b/1",)], "url string")
    assert [r.url for r in readers.not_imported(urls, done).collect()] == ["https://a.b/2"]
    (tmp_path / "urls.txt").write_text("nonsense\n")
    with pytest.raises(readers.MalformedLine):
        readers.check_urls(readers.url_lines(spark, str(tmp_path / "urls.txt")))


def test_browser_export(spark, tmp_path):
    text = """<DL><p>
<DT><H3>Other</H3>
<DL><p><DT><A HREF="https://no.example/">No</A></DL><p>
<DT><H3 ID="1"> Wanted </H3>
<DL><p>
<DT><A HREF="https://a.example/" ADD_DATE="1">A &amp; B</A>
<DT><A HREF="javascript:void(0)">J</A>
<DT><H3>Sub</H3>
<DL><p><DT><A HREF="https://sub.example/">Sub</A></DL><p>
<DT><A HREF="https://b.example/">B</A>
</DL><p>
<DT><A HREF="https://after.example/">After</A>
</DL>"""
    (tmp_path / "bookmarks.html").write_text(text)
    rows = readers.browser_export(spark, str(tmp_path / "bookmarks.html"), "Wanted").collect()
    assert [(r.url, r.title) for r in rows] == [("https://a.example/", "A & B"), ("https://b.example/", "B")]


def test_images_are_fetched_or_left_out(spark):
    pages = spark.createDataFrame([(1, "https://a.b/", "<img src='/x.png'><img src='/y.png'>")], "page_id int, url string, html string")

    def fetch(url):
        if url.endswith("y.png"):
            raise OSError
        return b"png", None

    rows = readers.fetched(readers.images(pages), fetch).collect()
    assert [(r.image_url, bytes(r.content), r.content_type) for r in rows] == [("https://a.b/x.png", b"png", "application/octet-stream")]


def test_sinks(spark, tmp_path):
    html = "<pre>\n a\r\n\tb </pre>"
    pages = spark.createDataFrame([("u", str(i), f"{html}{i}") for i in range(300)] + [("v", "7", "other"), ("v", "8", None)], "user_id string, bookmark_id string, html string")
    sinks.write_pages(pages, str(tmp_path / "pages"), 4)
    assert len(list((tmp_path / "pages").rglob("*.parquet"))) <= 8
    assert [r.html for r in sinks.stored_page(spark, str(tmp_path / "pages"), "u", "7", 4).collect()] == [html + "7"]
    assert [r.html for r in sinks.stored_page(spark, str(tmp_path / "pages"), "v", "8", 4).collect()] == [None]
    assert not sinks.stored_page(spark, str(tmp_path / "pages"), "v", "9", 4).collect()
    images = spark.createDataFrame([("i", b"1"), ("i", b"1"), ("j", b"2")], "image_id string, content binary")
    sinks.write_images(images, str(tmp_path / "images"))
    sinks.write_images(images, str(tmp_path / "images"), spark.read.parquet(str(tmp_path / "images")))
    assert spark.read.parquet(str(tmp_path / "images")).count() == 2


def test_pages_are_fetched_and_decoded(spark):
    answers = {"a": ("<p>é".encode(), None), "b": ("<p>é".encode("latin-1"), "text/html; charset=ISO-8859-1"), "c": (b'<meta charset="cp1252"><p>\x80', "text/html"), "d": (b"\xff", "text/html; charset=unknown")}
    urls = spark.createDataFrame([(u,) for u in "abcde"], "url string")
    rows = {r.url: r.html for r in readers.fetched_pages(urls, lambda u: answers[u]).collect()}
    assert rows == {"a": "<p>é", "b": "<p>é", "c": '<meta charset="cp1252"><p>€', "d": "\ufffd"}


def test_postings_table(spark):
    b = spark.createDataFrame([("u", "1", "Red cats", "cats and dogs", ["pets"]), ("u", "2", "Dogs", "only", None)], "user_id string, bookmark_id string, title string, text_content string, tags array<string>")
    sinks.write_postings(fts.postings(b), "postings_test", 2)
    index = spark.table("postings_test")
    assert [(r.bookmark_id, r.hits) for r in fts.search_postings(index, ["cat", "dog"], "u").collect()] == [("1", 3)]
    spark.sql("DROP TABLE postings_test")


def run_stream(spark, tmp_path, schema, batches, make, mode):
    source, name = tmp_path / "in", "t_" + tmp_path.name.replace("-", "_")
    source.mkdir()
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    try:
        for i, rows in enumerate(batches):
            (source / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def test_task_states(spark, tmp_path):
    batches = [[{"task_id": "a", "at": 1.0, "failed": True}, {"task_id": "b", "at": 1.0, "failed": False}], [{"task_id": "a", "at": 2.0, "failed": True}, {"task_id": "b", "at": 2.0, "failed": True}], [{"task_id": "a", "at": float(t), "failed": True} for t in range(3, 8)]]
    rows = run_stream(spark, tmp_path, "task_id string, at double, failed boolean", batches, queue_stream.latest_state, "update")
    last = {r.task_id: (r.status, r.retries) for r in rows}
    assert last["b"] == ("done", 0) and last["a"][0] == "fail"
    assert ("a", "pending", 2) in {tuple(r) for r in rows}


def test_limited_stream(spark, tmp_path):
    make = lambda i, at, ok=False: {"key": "k", "seq": i, "at": float(at), "success": ok}
    batches = [[make(0, 0), make(1, 1)], [make(2, 2)], [make(3, 61)]]
    rows = run_stream(spark, tmp_path, "key string, seq long, at double, success boolean", batches, lambda s: queue_stream.limited(s, 2, 60), "append")
    assert {r.seq: r.allowed for r in rows} == {0: True, 1: True, 2: False, 3: True}


def test_facets_by_time(spark):
    t = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), "done"), (datetime(2024, 1, 1, 0, 50), "done"), (datetime(2024, 1, 1, 1, 1), "fail")], "created_at timestamp, status string")
    assert sorted((r.start.hour, r.status, r.n) for r in queue_stream.facets_by_time(t).collect()) == [(0, "done", 2), (1, "fail", 1)]


def test_drain(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"task_id": "a"}\n{"task_id": "b"}')
    seen = []
    source = spark.readStream.schema("task_id string").json(str(tmp_path / "in"))
    queue_stream.drain(source, lambda df, n: seen.extend(r.task_id for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["a", "b"]
