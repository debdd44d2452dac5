import pytest

from quarry.functions import html as H
from quarry.functions import markup as M
from quarry.sources import readers

TEXT = "The river rose in the night, and by the morning the lower fields were under water, as they had been each spring since the mill was built. "


def one(spark, column, h):
    return spark.createDataFrame([(h,)], "h string").select(column.alias("x")).first()["x"]


def test_deep_markup_closes_nothing_outside():
    inner = "<div>" * 420 + "deep<script>alert(1)</script><div>more</div>" + "</div>" * 420
    assert M.sanitize(f"<div><p>before</p>{inner}<p>after</p></div><p>last</p>").endswith("<p>after</p></div><p>last</p>")
    assert "alert" not in M.sanitize("<div>" * 420 + "<script>alert(1)</script>ok") and "ok" in M.sanitize("<div>" * 420 + "<script>alert(1)</script>ok")
    assert "alert" not in M.sanitize("<div>" * 420 + "<svg><p>alert</p></svg>" + "<img src=a.png>")


IMAGES = """<!-- <img src="no.png"> --><script>'<img src="no.png">'</script><img src=plain.png><IMG ALT='>' SRC='a b.png'
 data-src="x"><img data-src="no.png"><img
src = "q&amp;r.png" src="no.png"/><img src=""><p title='<img src="no.png">'>"""


def test_images_are_read_by_the_parser(spark):
    assert one(spark, H.image_sources("h"), IMAGES) == ["plain.png", "a b.png", "q&r.png", ""]
    assert one(spark, H.image_sources("h"), None) is None


def test_images_are_rewritten_in_place(spark):
    got = M.with_sources(IMAGES, {"plain.png": "/s/1", "q&r.png": "/s/2?a&b", "no.png": "/never", "a b.png": r"\\1"})
    assert M.image_sources_of(got) == ["/s/1", r"\\1", "/s/2?a&b", ""]
    assert got.count("no.png") == IMAGES.count("no.png") and "/never" not in got and 'data-src="x"' in got
    pages = spark.createDataFrame([(1, "https://a.b/c/", "x\n<img src=pic.jpg>\n<img src='data:x'><!-- pic.jpg -->"), (2, "https://a.b/", None)], "page_id int, url string, html string")
    rows = {r.page_id: r.html for r in readers.rewritten_images(pages, readers.images(pages)).collect()}
    assert rows[1].startswith('x\n<img src="/static/1/') and rows[1].endswith("\">\n<img src='data:x'><!-- pic.jpg -->") and rows[2] is None


def test_titles(spark):
    assert one(spark, H.title("h"), "<svg><title>no</title></svg><title> </title><title>A &amp;\n B</title>") == "A & B"
    assert one(spark, H.title("h"), "<p>x") is None


PAGES = {
    # Lists of links score by their text without links.
    "links": ("<div id=nav>" + "<a href=/x>A link with many words, and commas, in it</a> " * 30 + f"</div><div><p>{TEXT * 2}</p><p>{TEXT * 2}</p></div>", 4, "A link"),
    # What a class says is furniture, though it is long.
    "sidebar": (f"<div class=sidebar><p>{'Buy now, only today, or never, they say. ' * 40}</p></div><div class=story><p>{TEXT * 3}</p><p>{TEXT}</p></div>", 4, "Buy now"),
    # Siblings that are text join the best element; those that are links do not.
    "siblings": (f"<body><div><p>{TEXT * 2}</p><p>{TEXT * 2}</p></div><p>{TEXT}</p><p><a href=/x>{'Elsewhere. ' * 12}</a></p></body>", 5, "Elsewhere"),
    # An article inside wrappers, with comments behind it.
    "wrapped": (f"<div><div><article><div><p>{TEXT * 2}</p></div><div><p>{TEXT * 2}</p></div></article></div></div><div id=comments>{'<p>I agree, well said, thank you for this one.</p>' * 20}</div>", 4, "I agree"),
}


@pytest.mark.parametrize("name", PAGES)
def test_articles(name):
    html, times, without = PAGES[name]
    text = M.text_of(html)
    assert text.count(TEXT.strip()) == times and without not in text


def test_hints_are_dropped_where_they_leave_too_little():
    html = f"<div class=sidebar><p>{TEXT * 6}</p></div><p>Short one.</p>"
    assert M.text_of(html).count(TEXT.strip()) == 6
    assert M.text_of("<p>Just a word</p>") == "Just a word"
    assert "<p>" in M.article_of(f"<div><p>{TEXT * 5}</p></div>") and M.text_of("") == ""


def test_pages_reach_python_in_small_batches_and_one_worker(spark):
    pages = spark.createDataFrame([("<title>T</title><p>" + "word, " * 40 + "<img src=a.png>",), (None,), ("",)], "html string")
    found = pages.select(H.title("html").alias("title"), M.article_text("html").alias("text"), M.article_html("html").alias("article"), M.sanitized("html").alias("clean"), H.image_sources("html").alias("images"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("BatchEvalPython") == 1
    rows = found.collect()
    assert rows[0].title == "T" and rows[0].text.startswith("word, word") and rows[0].images == ["a.png"]
    assert list(rows[1]) == [None] * 5 and rows[2].images == []


def test_no_page_is_kept_by_a_cycle():
    import gc
    import weakref

    class Page(dict):
        pass

    from quarry.functions import readability

    gc.collect()
    gc.disable()
    try:
        page = readability._Page(M.parsed.__wrapped__("<div>" + "<p>some words, and more of them here</p>" * 5 + "</div>"), True, True)
        page.best()
        gone = weakref.ref(page)
        del page
        assert gone() is None
    finally:
        gc.enable()
