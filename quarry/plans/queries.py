"""The registry: each operator as a query over the synthetic tables, with its SQL where SQL can say it.

All orders are total, floats are rounded to 6 digits, arrays come as joined
text and times as text, so that two engines give equal values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import markup as M
from ..functions.text import STOPWORDS, lexemes, words
from ..functions.urls import bookmark_id, canonical_url, domain
from ..operators import chunking, enrich, fts, fusion, history, index, limiter, mutations, paging, predicates, queues, rank, tags, vector, vector_index, versions
from ..operators.headline import headline
from ..operators.predicates import TagFilter
from ..operators.search import SearchRequest, hits, search
from ..operators.wordpiece import WordPiece, with_counts
from ..sources import adapt, readers
from ..sources.adapt import with_views
from ..streaming import queue_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NOW = datetime(2024, 1, 3)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _at(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


_AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_CREATED = _AT.format("created_at") + " AS created_at"


def _joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


# Search: pages, filters, facets


def _items(spark: SparkSession, d: str, request: SearchRequest, user: str = "3") -> DataFrame:
    return search(adapt.bookmarks(spark, d), user, request).items.select("bookmark_id", "url", "title", _at("created_at").alias("created_at"))


def _items_sql(where: str, tail: str) -> str:
    return f"{with_views('bookmarks')} SELECT bookmark_id, url, title, {_CREATED} FROM bookmarks b WHERE user_id = '3' AND {where} ORDER BY b.created_at DESC, bookmark_id {tail}"


@query(_items_sql("true", "LIMIT 20"))
def search_items_default_page(spark, d):
    return _items(spark, d, SearchRequest())


@query(_items_sql("true", "LIMIT 7 OFFSET 13"))
def search_items_offset_page(spark, d):
    return _items(spark, d, SearchRequest(limit=7, offset=13))


@query(_items_sql("list_has_all(tags, ['en', 'good'])", "LIMIT 20"))
def search_tags_and(spark, d):
    return _items(spark, d, SearchRequest(tags=TagFilter("and", ("en", "good"))))


@query(_items_sql("list_has_any(tags, ['fr', 'toxic'])", "LIMIT 20"))
def search_tags_or(spark, d):
    return _items(spark, d, SearchRequest(tags=TagFilter("or", ("fr", "toxic"))))


@query(_items_sql("(tags IS NULL OR len(tags) = 0)", "LIMIT 20"))
def search_tags_untagged(spark, d):
    return _items(spark, d, SearchRequest(tags=TagFilter("untagged")))


@query(_items_sql("true", "LIMIT 20"))
def search_tags_any(spark, d):
    return _items(spark, d, SearchRequest(tags=predicates.tool_tag_filter("untagged", None)))


@query(_items_sql("tags IS NOT NULL", "LIMIT 20"))
def search_tags_and_empty(spark, d):
    return _items(spark, d, SearchRequest(tags=TagFilter("and")))


@query(f"{with_views('bookmarks')} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM bookmarks WHERE user_id = '3' AND list_has_any(tags, ['en'])) GROUP BY tag")
def search_tag_facets(spark, d):
    return search(adapt.bookmarks(spark, d), "3", SearchRequest(tags=TagFilter("or", ("en",)))).tags


@query(f"{with_views('bookmarks')} SELECT count(*) AS total FROM bookmarks WHERE user_id = '3' AND list_has_all(tags, ['en'])")
def search_total(spark, d):
    return search(adapt.bookmarks(spark, d), "3", SearchRequest(tags=TagFilter("and", ("en",)), limit=3)).total


@query(f"{with_views('bookmarks')} SELECT user_id, tag, count(*) AS n FROM (SELECT user_id, unnest(tags) AS tag FROM bookmarks) GROUP BY user_id, tag")
def tag_counts_by_user(spark, d):
    return adapt.bookmarks(spark, d).select("user_id", F.explode("tags").alias("tag")).groupBy("user_id", "tag").agg(F.count("*").alias("n"))


@query(f"{with_views('bookmarks')} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM bookmarks) WHERE contains(lower(tag), 'src1') GROUP BY tag")
def tag_facets_sorted(spark, d):
    return tags.sorted_facets(adapt.bookmarks(spark, d), "SRC1")


# Lookups


@query(f"{with_views('bookmarks')} SELECT bookmark_id, url, {_CREATED} FROM bookmarks WHERE user_id = '4'")
def bookmarks_of_user(spark, d):
    return adapt.bookmarks(spark, d).where("user_id = '4'").select("bookmark_id", "url", _at("created_at").alias("created_at")).orderBy("created_at", "bookmark_id")


@query(f"{with_views('bookmarks')} SELECT bookmark_id, url, text_content FROM bookmarks WHERE user_id = '2' AND bookmark_id = '12'")
def bookmark_by_id(spark, d):
    return adapt.bookmarks(spark, d).where("user_id = '2' AND bookmark_id = '12'").select("bookmark_id", "url", "text_content").limit(1)


@query(f"{with_views('bookmarks')} SELECT bookmark_id, url FROM bookmarks WHERE user_id = '2' AND url = 'https://src2.example/42' OR (user_id = '3' AND url = 'https://src3.example/3')")
def bookmark_by_canonical_url(spark, d):
    b = adapt.bookmarks(spark, d).withColumn("c", canonical_url("url"))
    wanted = spark.createDataFrame([("2", "HTTPS://SRC2.example:443/42#top"), ("3", "https://src3.EXAMPLE/3")], "user_id string, u string").select("user_id", canonical_url("u").alias("c"))
    return b.join(F.broadcast(wanted), ["user_id", "c"]).select("bookmark_id", "url")  # two rows


@query(f"{with_views('bookmarks')} SELECT bookmark_id, {_CREATED} FROM bookmarks WHERE user_id = '5' AND list_contains(tags, 'de')")
def bookmarks_by_tag(spark, d):
    return adapt.bookmarks(spark, d).where((F.col("user_id") == "5") & predicates.has_tag("de")).select("bookmark_id", _at("created_at").alias("created_at")).orderBy("created_at", "bookmark_id")


@query(f"{with_views('chunks')} SELECT chunk_id, chunk_index FROM chunks WHERE chunk_id IN ('7', '205', '407', '99999') AND user_id IN ('5', '7')")
def chunks_by_ids(spark, d):
    return adapt.chunks(spark, d).where(F.col("chunk_id").isin("7", "205", "407", "99999") & F.col("user_id").isin("5", "7")).select("chunk_id", "chunk_index").orderBy("chunk_index")


# Tags


def _dirty(spark, d):
    docs = adapt.bookmarks(spark, d)
    return docs.withColumn("raw", F.split(F.concat(F.lit("  "), F.upper(F.element_at(F.split("domain", r"\."), 1)), F.lit(" ,"), F.col("domain"), F.lit(", ,"), F.element_at(F.split("domain", r"\."), 1), F.lit(",New Tag")), ","))


_DIRTY_SQL = "string_split('  ' || upper(string_split(domain, '.')[1]) || ' ,' || domain || ', ,' || string_split(domain, '.')[1] || ',New Tag', ',')"
_CLEAN_SQL = "[upper(string_split(domain, '.')[1]).lower(), domain, 'new tag']"


@query(f"{with_views('bookmarks')} SELECT bookmark_id, array_to_string({_CLEAN_SQL}, '|') AS tags FROM bookmarks")
def tags_normalize(spark, d):
    return _dirty(spark, d).select("bookmark_id", _joined(tags.normalized("raw")).alias("tags"))


@query(f"{with_views('bookmarks')} SELECT bookmark_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(tags, []), {_CLEAN_SQL}))), '|') AS tags FROM bookmarks")
def tags_append(spark, d):
    return _dirty(spark, d).select("bookmark_id", _joined(F.array_sort(tags.appended("tags", "raw"))).alias("tags"))


@query(f"{with_views('bookmarks')} SELECT domain, array_to_string(list_sort(list_distinct(flatten(list(tags)))), '|') AS tags FROM bookmarks WHERE len(tags) > 0 GROUP BY domain")
def tags_merged(spark, d):
    return tags.merged(adapt.bookmarks(spark, d), ["domain"]).select("domain", _joined("tags").alias("tags"))


# Full text. `simple` keeps words as they are, which SQL can follow; `english` adds stop words and stems.

_WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_VECTOR = f"""{with_views("bookmarks")},
v AS (SELECT *, {_WORDS.format("title")} AS tl, {_WORDS.format("text_content")} AS xl, {_WORDS.format("array_to_string(coalesce(tags, []), ' ')")} AS gl FROM bookmarks),
s AS (SELECT *, list_concat(list_concat(tl, xl), gl) AS al FROM v)"""
_TEXT = "(' ' || array_to_string(al, ' ') || ' ')"


def _simple(spark, d):
    return fts.search_columns(adapt.bookmarks(spark, d), "simple")


@query(f"{_VECTOR} SELECT bookmark_id FROM s WHERE list_contains(al, 'thing')")
def fts_term_match(spark, d):
    return fts.search(_simple(spark, d), fts.web_query("Thing!", "simple")).select("bookmark_id")


@query(f"{_VECTOR} SELECT bookmark_id FROM s WHERE (list_contains(al, 'the') AND list_contains(al, 'from') AND NOT list_contains(al, 'only')) OR list_contains(al, 'auf')")
def fts_and_or_not(spark, d):
    return fts.search(_simple(spark, d), fts.web_query("the & from -only or auf", "simple")).select("bookmark_id")


@query(f"{_VECTOR} SELECT bookmark_id FROM s WHERE contains({_TEXT}, ' of the ') AND NOT contains({_TEXT}, ' in the ')")
def fts_phrase(spark, d):
    return fts.search(_simple(spark, d), fts.web_query('"of the" -"in the"', "simple")).select("bookmark_id")


# Rank of one term from the weights of its places, which fall from title to tags; rank of a conjunction from all pairs of places.
_OF = "len(list_filter({part}, lambda x: x = '{t}'))"
_OCCURRENCE = "coalesce(list_sum(list_transform(range(1, {a} + {b} + {c} + 1), lambda j: CASE WHEN j <= {a} THEN 1.0 WHEN j <= {a} + {b} THEN 0.4 ELSE 0.2 END::DOUBLE / (j * j))), 0) / 1.64493406685::DOUBLE"


def _occurrence(term: str) -> str:
    return _OCCURRENCE.format(**{k: _OF.format(part=p, t=term) for k, p in (("a", "tl"), ("b", "xl"), ("c", "gl"))})


def _proximity_sql(*terms: str) -> str:
    """CTEs that end in `prox`: bookmark_id, rank."""
    return f"""hit AS (SELECT bookmark_id, x, i, CASE WHEN i <= a THEN 1.0 WHEN i <= a + b THEN 0.4 ELSE 0.2 END::DOUBLE AS w FROM (SELECT bookmark_id, len(tl) AS a, len(xl) AS b, unnest(al) AS x, generate_subscripts(al, 1) AS i FROM s) WHERE x IN ({", ".join(f"'{t}'" for t in terms)})),
prox AS (SELECT p.bookmark_id, 1 - exp(sum(CASE WHEN p.i = q.i THEN 0 ELSE ln(1 - sqrt(p.w * q.w * CASE WHEN abs(p.i - q.i) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(p.i - q.i) / 1.5 - 2)) END)) END)) AS rank FROM hit p JOIN hit q ON p.bookmark_id = q.bookmark_id AND p.x < q.x GROUP BY p.bookmark_id)"""


_RANKED_PAGE = f"{_VECTOR}, {_proximity_sql('the', 'src0')} SELECT bookmark_id, round(rank, 6) AS rank FROM s JOIN prox USING (bookmark_id) WHERE list_contains(al, 'the') AND list_contains(al, 'src0') ORDER BY round(rank, 6) DESC, bookmark_id LIMIT 20"


@query(_RANKED_PAGE)
def fts_ranked_page(spark, d):
    found = fts.search(_simple(spark, d), fts.web_query("the src0", "simple"))
    return paging.page(found.select("bookmark_id", F.round("rank", 6).alias("rank")), F.desc("rank"), "bookmark_id")


_PHRASE_RANK = f"{_VECTOR}, {_proximity_sql('of', 'the')} SELECT bookmark_id, round(rank, 6) AS rank FROM s JOIN prox USING (bookmark_id) WHERE contains({_TEXT}, ' of the ')"


@query(_PHRASE_RANK)
def fts_phrase_rank(spark, d):
    return fts.search(_simple(spark, d), fts.web_query('"of the"', "simple")).select("bookmark_id", F.round("rank", 6).alias("rank"))


# The same from a stored index, whose rows are all that these queries read.

_STORED: dict[tuple[str, str], str] = {}


def _index(spark, d) -> DataFrame:
    """The `simple` index of a folder's bookmarks, stored once per session in the warehouse."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        name = f"fts_index_{uuid.uuid4().hex}"
        index.write(index.build(adapt.bookmarks(spark, d), "simple", block_docs=64), name, 16)
        _STORED[key] = name
    return spark.table(_STORED[key])


@query(f"{_VECTOR} SELECT bookmark_id FROM s WHERE contains({_TEXT}, ' of the ') AND NOT contains({_TEXT}, ' in the ')")
def fts_phrase_indexed(spark, d):
    return index.search(_index(spark, d), fts.web_query('"of the" -"in the"', "simple"), None).select("bookmark_id")


@query(f"{_VECTOR} SELECT bookmark_id FROM s WHERE (list_contains(al, 'the') AND list_contains(al, 'from') AND NOT list_contains(al, 'only')) OR list_contains(al, 'auf')")
def fts_and_or_not_indexed(spark, d):
    return index.search(_index(spark, d), fts.web_query("the & from -only or auf", "simple"), None).select("bookmark_id")


@query(f"{_VECTOR} SELECT bookmark_id FROM s WHERE user_id = '3' AND NOT list_contains(al, 'the')")
def fts_without_indexed(spark, d):
    return index.search(_index(spark, d), fts.web_query("-the", "simple"), "3").select("bookmark_id")


@query(_RANKED_PAGE)
def fts_ranked_page_indexed(spark, d):
    found = index.search(_index(spark, d), fts.web_query("the src0", "simple"), None)
    return paging.page(found.select("bookmark_id", F.round("rank", 6).alias("rank")), F.desc("rank"), "bookmark_id")


_ANY_RANK = f"(({_occurrence('the')}) + ({_occurrence('from')}) + ({_occurrence('auf')})) / 3"


@query(f"{_VECTOR} SELECT bookmark_id, round({_ANY_RANK}, 6) AS rank FROM s WHERE user_id = '3' AND len(list_filter(al, lambda x: x IN ('the', 'from', 'auf'))) > 0 ORDER BY round({_ANY_RANK}, 9) DESC, bookmark_id LIMIT 15")
def fts_top_indexed(spark, d):
    return index.top(_index(spark, d), fts.web_query("the or from or auf", "simple"), "3", 15).select("bookmark_id", F.round("rank", 6).alias("rank"))


@query(f"{_VECTOR} SELECT bookmark_id, round(({_occurrence('the')}) / (1 + log2(len(al) + 1)), 6) AS rank FROM s WHERE list_contains(al, 'the')".replace("(1 + log2(len(al) + 1))", "log2(len(al) + 1) / len(al)"))
def fts_rank_normalized_indexed(spark, d):
    found = index.search(_index(spark, d), fts.web_query("the", "simple"), None, rank.BY_LOG_LENGTH | rank.BY_LENGTH)
    return found.select("bookmark_id", F.round("rank", 6).alias("rank"))


# For two words the covers are the neighbours among the hits that are different words.
_HEADLINE = f"""{_VECTOR}, t AS (SELECT bookmark_id, regexp_extract_all(text_content, '[\\p{{L}}\\p{{N}}]+') AS ws, string_split_regex(text_content, '[\\p{{L}}\\p{{N}}]+') AS seps FROM s WHERE user_id = '3'),
w AS (SELECT bookmark_id, i, word, sep, n, lower(word) IN ('the', 'of') AS hit, len(word) <= 3 AND lower(word) NOT IN ('the', 'of') AS short FROM (SELECT bookmark_id, len(ws) AS n, unnest(ws) AS word, unnest(seps[2:]) AS sep, generate_subscripts(ws, 1) AS i FROM t WHERE len(ws) > 0)),
h AS (SELECT bookmark_id, n, i AS q, lower(word) AS x, lag(i) OVER p AS p, lag(lower(word)) OVER p AS y FROM w WHERE hit WINDOW p AS (PARTITION BY bookmark_id ORDER BY i)),
c AS (SELECT bookmark_id, n, p, q FROM h WHERE x <> y),
f AS (SELECT c.bookmark_id, c.p, c.q, CASE WHEN q - p + 1 >= 35 THEN coalesce(max(CASE WHEN w.i <= p + 34 AND (NOT w.short OR w.i = p + 14) THEN w.i END), p + 34)
      ELSE coalesce(min(CASE WHEN w.i >= greatest(q, p + 14) AND NOT w.short THEN w.i END), least(c.n, p + 34)) END AS e
    FROM c JOIN w ON w.bookmark_id = c.bookmark_id AND w.i BETWEEN p + 14 AND p + 34 OR (w.bookmark_id = c.bookmark_id AND w.i = p) GROUP BY c.bookmark_id, c.p, c.q, c.n),
g AS (SELECT *, CASE WHEN q - p + 1 >= 35 THEN p ELSE greatest(1, least(p, e - 14)) END AS b FROM f),
chosen AS (SELECT g.bookmark_id, g.p, g.b, g.e, row_number() OVER (PARTITION BY g.bookmark_id ORDER BY CAST(g.e >= g.q AS INTEGER) DESC, sum(CAST(w.hit AS INTEGER)) DESC, bool_or(w.i = g.e AND NOT w.short) DESC, g.p) AS nth
    FROM g JOIN w ON w.bookmark_id = g.bookmark_id AND w.i BETWEEN g.b AND g.e GROUP BY g.bookmark_id, g.p, g.q, g.b, g.e),
o AS (SELECT t.bookmark_id, coalesce(k.b, 1) AS b, coalesce(k.e, 15) AS e FROM t LEFT JOIN chosen k ON k.bookmark_id = t.bookmark_id AND nth = 1)
SELECT o.bookmark_id, coalesce(string_agg(CASE WHEN hit THEN '<mark>' || word || '</mark>' ELSE word END || CASE WHEN i < least(e, n) THEN sep ELSE '' END, '' ORDER BY i), '') AS search_match
FROM o LEFT JOIN w ON w.bookmark_id = o.bookmark_id AND w.i BETWEEN b AND e GROUP BY o.bookmark_id"""


@query(_HEADLINE)
def fts_headline_simple(spark, d):
    b = adapt.bookmarks(spark, d).where("user_id = '3'")
    return b.select("bookmark_id", headline("text_content", fts.web_query("the of", "simple")).alias("search_match"))


@query()
def fts_headline(spark, d):
    return search(adapt.bookmarks(spark, d), "3", SearchRequest(query="things or eronly or thand", limit=10)).items.select("bookmark_id", "search_match")


@query()
def fts_english_stem(spark, d):
    return hits(adapt.bookmarks(spark, d), "3", SearchRequest(query="thing -tested")).select("bookmark_id", "rank")


@query("SELECT bookmark_id, n FROM (SELECT bookmark_id, 0 AS n FROM (SELECT '' AS bookmark_id) WHERE false)")
def fts_empty_query(spark, d):
    return hits(adapt.bookmarks(spark, d), "3", SearchRequest(query='"" the', language="english")).select("bookmark_id", F.lit(0).alias("n"))


@query(f"{_VECTOR}, p AS (SELECT user_id, bookmark_id, 'A' AS weight, unnest(tl) AS lexeme FROM s UNION ALL SELECT user_id, bookmark_id, 'B', unnest(xl) FROM s UNION ALL SELECT user_id, bookmark_id, 'C', unnest(gl) FROM s) SELECT lexeme, weight, count(DISTINCT bookmark_id) AS docs, count(*) AS hits FROM p GROUP BY lexeme, weight")
def fts_postings_stats(spark, d):
    p = fts.postings(adapt.bookmarks(spark, d), "simple")
    return p.groupBy("lexeme", "weight").agg(F.count("*").alias("docs"), F.sum(F.size("positions")).alias("hits"))


@query(f"{_VECTOR} SELECT bookmark_id, CAST(len(list_filter(al, lambda x: x IN ('the', 'of'))) AS BIGINT) AS hits FROM s WHERE user_id = '3' AND list_has_all(al, ['the', 'of'])")
def fts_search_postings(spark, d):
    return fts.search_postings(fts.postings(adapt.bookmarks(spark, d).where("user_id = '3'"), "simple"), ["the", "of"], "3")


# Vectors

_SIM = "list_cosine_similarity(c.embedding, q.embedding)"
_QUERY = "(SELECT embedding FROM chunks WHERE vec_id = 17)"


def _probe(spark, d, vec_id: int = 17) -> list[float]:
    return adapt.chunks(spark, d).where(F.col("vec_id") == vec_id).first()["embedding"]


@query(f"{with_views('chunks')} SELECT c.chunk_id, round({_SIM}, 6) AS similarity FROM chunks c, {_QUERY} q WHERE {_SIM} >= 0.1 ORDER BY {_SIM} DESC, chunk_id LIMIT 12")
def knn_threshold_topk(spark, d):
    return vector.nearest(adapt.chunks(spark, d), _probe(spark, d), 12, 0.1).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query(f"{with_views('chunks')}, r AS (SELECT q.vec_id AS query_id, c.chunk_id, {_SIM} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, c.chunk_id) AS rank FROM chunks c, chunks q WHERE q.vec_id % 50 = 0) SELECT query_id, chunk_id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_batch_topk(spark, d):
    c = adapt.chunks(spark, d)
    queries = c.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.nearest_batch(c, queries, 5).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


@query()
def knn_ivf_topk(spark, d):
    c = adapt.chunks(spark, d)
    index = vector.InvertedLists.fit(c, 16)
    return index.nearest(index.assigned(c), _probe(spark, d), 12, probes=8).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query()
def knn_index_batch(spark, d):
    """Batches of queries over the coded index, half of it appended later; `recall` is against the exact answer."""
    c = adapt.chunks(spark, d)
    built = vector_index.VectorIndex.fit(c, 16, 32)
    index = built.assigned(c.where("vec_id % 2 = 0")).unionByName(built.assigned(c.where("vec_id % 2 = 1")))
    queries = c.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = built.nearest_batch(index, c, queries, 5, probes=12)
    exact = vector.nearest_batch(c, queries, 5).select("query_id", F.col("chunk_id").alias("exact_id"))
    both = found.join(exact, (found["query_id"] == exact["query_id"]) & (found["chunk_id"] == exact["exact_id"]), "left").select(found["query_id"], "chunk_id", "similarity", "rank", "exact_id")
    recall = F.count("exact_id").over(Window.partitionBy()) / F.count("*").over(Window.partitionBy())  # k rows a query
    return both.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank", F.round(recall, 6).alias("recall"))


@query(f"{with_views('chunks')} SELECT count(*) AS n, min(len(embedding)) AS lo, max(len(embedding)) AS hi FROM chunks")
def embedding_dimensions(spark, d):
    c = adapt.chunks(spark, d)
    size = vector.check_dimensions(c)
    return c.agg(F.count("*").alias("n"), F.lit(size).cast("long").alias("lo"), F.max(F.size("embedding")).cast("long").alias("hi"))


_HYBRID = f"""{_VECTOR.replace("WITH ", f"WITH {adapt.SQL['chunks']},", 1)},
m AS (SELECT c.bookmark_id, c.chunk_id, {_SIM} AS similarity FROM chunks c, {_QUERY} q WHERE {_SIM} >= 0.0 ORDER BY {_SIM} DESC, chunk_id LIMIT 12),
vm AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS vr FROM m),
f AS (SELECT bookmark_id, {_occurrence('the')} AS sc FROM s WHERE list_contains(al, 'the')),
fr AS (SELECT *, row_number() OVER (ORDER BY sc DESC, bookmark_id) AS fr FROM f),
h AS (SELECT chunk_id, similarity, vr, coalesce(sc, 0.0) AS sc, coalesce(fr, 13) AS fr FROM vm LEFT JOIN fr USING (bookmark_id))"""


def _hybrid(spark, d) -> DataFrame:
    found = vector.nearest(adapt.chunks(spark, d), _probe(spark, d), 12, 0.0).select("bookmark_id", "chunk_id", "similarity")
    return fusion.hybrid(found, fts.search(_simple(spark, d), fts.web_query("the", "simple")).select("bookmark_id", "rank"), 12)


@query(f"{_HYBRID} SELECT chunk_id, round(1.0 / (60 + vr) + 1.0 / (60 + fr), 6) AS score FROM h")
def hybrid_rrf(spark, d):
    return _hybrid(spark, d).select("chunk_id", F.round(fusion.rrf(), 6).alias("score"))


@query(f"{_HYBRID} SELECT chunk_id, round(similarity * 0.2 + sc * 0.8, 6) AS score FROM h")
def hybrid_weighted(spark, d):
    return _hybrid(spark, d).select("chunk_id", F.round(fusion.weighted(0.1, 0.4), 6).alias("score"))


# Retrieval pipeline: four question variants over the chunks

_MATCHES = f"""{with_views("chunks")},
qs AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS qpos, embedding FROM chunks WHERE vec_id IN (10, 11, 210, 17)),
m AS (SELECT q.qpos, c.chunk_id, round({_SIM}, 6) AS similarity, row_number() OVER (PARTITION BY q.qpos ORDER BY {_SIM} DESC, c.chunk_id) AS pos FROM chunks c, qs q),
top AS (SELECT * FROM m WHERE pos <= 12)"""


def _variants(spark, d) -> DataFrame:
    c = adapt.chunks(spark, d)
    order = {10: 0, 11: 1, 17: 2, 210: 3}
    qpos = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("vec_id").cast("int"))
    queries = c.where(F.col("vec_id").isin(*order)).select(qpos.alias("query_id"), F.col("embedding").alias("query"))
    found = vector.nearest_batch(c, queries, 12)
    return found.select(F.col("query_id").alias("qpos"), "chunk_id", F.round("similarity", 6).alias("similarity"), F.col("rank").alias("pos"))


@query(f"{_MATCHES}, l AS (SELECT *, lag(chunk_id) OVER (ORDER BY similarity DESC, qpos, pos) AS b FROM top), k AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, qpos, pos) AS rank FROM l WHERE b IS NULL OR b <> chunk_id) SELECT CAST(rank AS INTEGER) AS rank, chunk_id, similarity FROM k WHERE rank <= 30")
def rag_merge_adjacent_dedup(spark, d):
    return fusion.merge_matches(_variants(spark, d), 30).select("rank", "chunk_id", "similarity")


@query(f"{_MATCHES}, g AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY similarity DESC, qpos, pos) AS n FROM top), k AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, qpos, pos) AS rank FROM g WHERE n = 1) SELECT CAST(rank AS INTEGER) AS rank, chunk_id, similarity FROM k WHERE rank <= 30")
def rag_merge_global(spark, d):
    return fusion.merge_matches(_variants(spark, d), 30, "global").select("rank", "chunk_id", "similarity")


@query(f"""{with_views("bookmarks")}, t AS (SELECT user_id, bookmark_id, created_at, doc_id, len(list_filter(string_split_regex(text_content, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS tokens FROM bookmarks),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY user_id ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS running FROM t)
SELECT user_id, bookmark_id, CAST(running AS BIGINT) AS running_tokens FROM r WHERE running <= 3896""")
def rag_token_budget(spark, d):
    t = adapt.bookmarks(spark, d).select("user_id", "bookmark_id", "doc_id", fusion.word_tokens("text_content").alias("tokens"))
    return fusion.within_budget(t, order=(F.desc("doc_id"),), keys=("user_id",)).select("user_id", "bookmark_id", "running_tokens")


# A vocabulary of stop words and single characters: a word is its longest stop word in front, then a token for each further character.
_CHARACTERS = tuple("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?'\"-")
_CODEC = WordPiece(("[UNK]", *dict.fromkeys([*_CHARACTERS, *STOPWORDS]), *(f"##{c}" for c in _CHARACTERS)))
_PIECES = f"""{with_views("bookmarks")}, sw AS (SELECT unnest([{", ".join(f"'{w}'" for w in STOPWORDS)}]) AS p),
w AS (SELECT user_id, bookmark_id, doc_id, unnest(regexp_extract_all(text_content, '[!-/:-@\\[-`{{-~\\p{{P}}]|[^\\s!-/:-@\\[-`{{-~\\p{{P}}]+')) AS word FROM bookmarks),
v AS (SELECT word, CASE WHEN len(word) > 100 OR NOT regexp_full_match(word, '[A-Za-z0-9.,;:!?''"-]+') THEN 1 ELSE 1 + len(word) - greatest(1, coalesce(max(len(p)), 1)) END AS n FROM (SELECT DISTINCT word FROM w) LEFT JOIN sw ON starts_with(word, p) GROUP BY word),
t AS (SELECT b.user_id, b.bookmark_id, b.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens FROM bookmarks b LEFT JOIN w ON w.bookmark_id = b.bookmark_id LEFT JOIN v ON v.word = w.word GROUP BY b.user_id, b.bookmark_id, b.doc_id)"""


@query(f"{_PIECES} SELECT bookmark_id, tokens FROM t")
def wordpiece_counts(spark, d):
    return adapt.bookmarks(spark, d).select("bookmark_id", _CODEC.count("text_content").cast("long").alias("tokens"))


@query(f"{_PIECES}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY user_id ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS running FROM t) SELECT user_id, bookmark_id, CAST(running AS BIGINT) AS running_tokens FROM r WHERE running <= 7992")
def rag_wordpiece_budget(spark, d):
    t = with_counts(adapt.bookmarks(spark, d).select("user_id", "bookmark_id", "doc_id", "text_content"), _CODEC, "text_content")
    return fusion.within_budget(t, 8192, order=(F.desc("doc_id"),), keys=("user_id",)).select("user_id", "bookmark_id", "running_tokens")


@query(f"{_PIECES} SELECT bookmark_id, CAST(unnest(range(0, tokens, 250)) // 250 AS INTEGER) AS chunk_index FROM t WHERE tokens > 0")
def wordpiece_windows(spark, d):
    b = adapt.bookmarks(spark, d).select("bookmark_id", "text_content")
    return chunking.token_windows(b, chunking.ChunkConfig(300, 50), _CODEC.encode, _CODEC.decode).select("bookmark_id", "chunk_index")


@query(f"""{with_views("sessions", "chunks")}, p AS (SELECT * FROM sessions WHERE user_id = '1' ORDER BY created_at DESC, session_id LIMIT 20),
c AS (SELECT session_id, unnest(relevant_chunks) AS chunk_id, generate_subscripts(relevant_chunks, 1) AS pos FROM p),
f AS (SELECT session_id, string_agg(c.chunk_id, '|' ORDER BY pos) AS sources FROM c JOIN chunks USING (chunk_id) GROUP BY session_id)
SELECT p.session_id, question, {_AT.format("created_at")} AS created_at, coalesce(sources, '') AS sources FROM p LEFT JOIN f USING (session_id)""")
def rag_history_sources(spark, d):
    page = paging.history_page(adapt.sessions(spark, d).where("user_id = '1'"))
    found = history.with_sources(page, adapt.chunks(spark, d))
    return found.select("session_id", "question", _at("created_at").alias("created_at"), _joined(F.transform("sources", lambda s: s["chunk_id"])).alias("sources"))


@query(f"{with_views('sessions')} SELECT user_id, count(*) AS n, count(answer) AS answered FROM sessions GROUP BY user_id")
def rag_session_counts(spark, d):
    return adapt.sessions(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count("answer").alias("answered"))


@query(f"{with_views('sessions')} SELECT DISTINCT unnest(relevant_chunks) AS chunk_id FROM sessions")
def rag_cited_ids(spark, d):
    return history.cited_ids(adapt.sessions(spark, d))


# Tasks and queues


@query(f"{with_views('tasks')} SELECT task_id, url, status FROM tasks WHERE url LIKE '%cl_ck.example/1%' AND status = 'pending' AND list_has_all(tags, ['click']) AND created_at BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def tasks_search_filtered(spark, d):
    t = adapt.tasks(spark, d)
    parts = [predicates.url_like("cl_ck.example/1"), F.col("status") == "pending", TagFilter("and", ("click",)).column(), predicates.between("created_at", datetime(2024, 1, 1, 6), datetime(2024, 1, 20))]
    return t.where(predicates.all_of(parts)).select("task_id", "url", "status")


@query(f"{with_views('tasks')} SELECT task_id, status FROM tasks WHERE task_id > '0000000040' ORDER BY task_id LIMIT 25")
def tasks_keyset_page(spark, d):
    return paging.keyset_page(adapt.tasks(spark, d), "task_id", "0000000040").select("task_id", "status")


@query(f"{with_views('tasks')} SELECT task_id, (SELECT count(*) FROM tasks WHERE task_id > '0000000040') > 25 AS has_more FROM tasks WHERE task_id > '0000000040' ORDER BY task_id LIMIT 25")
def tasks_has_more(spark, d):
    return paging.keyset_page(adapt.tasks(spark, d), "task_id", "0000000040").select("task_id", "has_more")


@query(f"{with_views('tasks')} SELECT task_id, '2024-01-03 00:05:00' AS next_delivery FROM tasks WHERE status = 'pending' AND next_delivery <= TIMESTAMP '2024-01-03' ORDER BY tasks.next_delivery, created_at, task_id LIMIT 10")
def tasks_claim(spark, d):
    return queues.claim_tasks(adapt.tasks(spark, d), NOW)[0].select("task_id", _at("next_delivery").alias("next_delivery"))


_AI = f"""{with_views("bookmarks")}, a AS (SELECT *, created_at AS due, CASE WHEN coalesce(trim(summary), '') <> '' THEN 'done' ELSE 'pending' END AS summary_status,
  CASE WHEN coalesce(len(tags), 0) > 0 THEN 'done' ELSE 'pending' END AS tag_status, CASE WHEN strlen(text_content) >= 200 THEN 'pending' ELSE 'done' END AS embedding_status FROM bookmarks)"""


def _with_state(spark, d) -> DataFrame:
    b = queues.initial_status(adapt.bookmarks(spark, d))
    extra = {f"{k}_{c}": v for k in ("text_ai", "embedding") for c, v in (("attempts", (F.col("doc_id") % 6).cast("int")), ("next_attempt_at", F.col("created_at")), ("fail_reason", F.lit(None).cast("string")))}
    return b.withColumns(extra)


@query(f"{_AI} SELECT bookmark_id, summary_status = 'pending' AS needs_summary, tag_status = 'pending' AS needs_tags FROM a WHERE (summary_status = 'pending' OR tag_status = 'pending') AND due <= TIMESTAMP '2024-01-03' ORDER BY due, created_at, user_id, bookmark_id LIMIT 10")
def text_ai_claim(spark, d):
    return queues.claim_ai(_with_state(spark, d), "text_ai", NOW)[0].select("bookmark_id", "needs_summary", "needs_tags")


@query(f"{_AI} SELECT bookmark_id FROM a WHERE embedding_status = 'pending' AND due <= TIMESTAMP '2024-01-03' ORDER BY due, created_at, user_id, bookmark_id LIMIT 5")
def embedding_claim(spark, d):
    return queues.claim_ai(_with_state(spark, d), "embedding", NOW)[0].select("bookmark_id")


@query(f"{_AI} SELECT bookmark_id, summary_status, tag_status, CASE WHEN summary_status = 'done' AND tag_status = 'done' THEN 'done' ELSE 'pending' END AS text_ai_status, embedding_status FROM a")
def initial_status(spark, d):
    return queues.initial_status(adapt.bookmarks(spark, d)).select("bookmark_id", "summary_status", "tag_status", "text_ai_status", "embedding_status")


@query(f"{with_views('bookmarks')} SELECT bookmark_id, CASE WHEN length(text_content) >= 200 THEN 'pending' ELSE 'done' END AS embedding_status FROM bookmarks")
def reset_embedding(spark, d):
    return queues.reset_embedding(_with_state(spark, d), NOW).select("bookmark_id", "embedding_status")


@query(f"{with_views('tasks')} SELECT task_id, CASE WHEN status <> 'fail' THEN 'done' WHEN retries < 5 THEN 'pending' ELSE 'fail' END AS status, CASE WHEN status = 'fail' AND retries < 5 THEN retries + 1 END AS retries, CASE WHEN status = 'fail' AND retries >= 5 THEN 'timeout' END AS fail_reason FROM tasks")
def retry_transition(spark, d):
    return queues.task_outcome(adapt.tasks(spark, d), F.col("status") == "fail", F.lit("timeout")).select("task_id", "status", "retries", "fail_reason")


@query("""SELECT CAST(doc_id AS VARCHAR) AS bookmark_id, CAST(doc_id % 6 + 1 AS INTEGER) AS attempts, CASE WHEN doc_id % 6 + 1 >= 5 THEN 'fail' ELSE 'pending' END AS status,
  strftime(TIMESTAMP '2024-01-03' + CASE WHEN doc_id % 6 + 1 >= 5 THEN INTERVAL 0 MINUTE ELSE to_minutes(CAST([5, 15, 60, 360][doc_id % 6 + 1] AS BIGINT)) END, '%Y-%m-%d %H:%M:%S') AS next_at, 2048 AS reason_chars FROM documents""")
def failure_transition(spark, d):
    out = queues.ai_failure(_with_state(spark, d), "embedding", NOW, F.lit("x" * 2049))
    return out.select("bookmark_id", F.col("embedding_attempts").alias("attempts"), F.col("embedding_status").alias("status"), _at("embedding_next_attempt_at").alias("next_at"), F.length("embedding_fail_reason").alias("reason_chars"))


@query("SELECT event_id, CAST([5, 15, 60, 360, 1440][greatest(1, least(5, event_id % 8))] AS INTEGER) AS minutes FROM events")
def backoff_schedule(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", queues.backoff_minutes((F.col("event_id") % 8).cast("int")).alias("minutes"))


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS key, event_id AS seq, epoch_us(ts) / 1e6 AS t, event_type = 'signup' AS ok, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'signup')),
w(key, i, seq, start, n, allowed, retry_after) AS (
  SELECT key, i, seq, CASE WHEN NOT ok THEN t END, CASE WHEN ok THEN 0 ELSE 1 END, true, CAST(0 AS BIGINT) FROM e WHERE i = 1
  UNION ALL
  SELECT e.key, e.i, e.seq,
    CASE WHEN w.start IS NULL OR t - w.start >= 86400 THEN CASE WHEN NOT ok THEN t END WHEN n >= 5 THEN w.start WHEN NOT ok THEN w.start END,
    CASE WHEN w.start IS NULL OR t - w.start >= 86400 THEN CASE WHEN ok THEN 0 ELSE 1 END WHEN n >= 5 THEN n WHEN ok THEN 0 ELSE n + 1 END,
    w.start IS NULL OR t - w.start >= 86400 OR n < 5,
    CASE WHEN w.start IS NULL OR t - w.start >= 86400 OR n < 5 THEN 0 ELSE greatest(1, CAST(trunc(w.start + 86400 - t) AS BIGINT)) END
  FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1)
SELECT key, seq, allowed, retry_after FROM w""")
def rate_limit_decisions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type IN ('error', 'signup')")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    # The events are far apart, so the window is a day.
    return limiter.decisions(e.select((F.col("user_id") % 20).cast("string").alias("key"), F.col("event_id").alias("seq"), at.alias("at"), (F.col("event_type") == "signup").alias("success")), 5, 86400).select("key", "seq", "allowed", "retry_after")


@query("""WITH e AS (SELECT user_id % 20 AS k, event_id, epoch_us(date_trunc('second', ts)) // 1000000 AS t FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS rn FROM e)
SELECT event_id, round(CAST(rn * 6000.0 + max(t - rn * 6000.0) OVER (PARTITION BY k ORDER BY rn ROWS UNBOUNDED PRECEDING) AS DOUBLE), 3) AS release FROM n""")
def pacing_release_times(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    t = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    r = e.select((F.col("user_id") % 20).alias("k"), "event_id", t.alias("t"))
    return queues.pacing(r, "t", 6000.0, ("k",), ("event_id",)).select("event_id", F.round("release", 3).alias("release"))


# Pages: identity, text, images

_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"


@query(f"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {_HOST} || CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END
  || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS canonical FROM pages""")
def url_canonical(spark, d):
    return adapt.pages(spark, d).select("page_id", canonical_url("url").alias("canonical"))


@query(f"SELECT page_id, {_HOST} AS domain FROM pages")
def url_domain(spark, d):
    return adapt.pages(spark, d).select("page_id", domain("url").alias("domain"))


@query(f"{with_views('bookmarks')} SELECT user_id, url, 'pending' AS status, array_to_string(tags, '|') AS tags, {_CREATED}, {_AT.format('created_at')} AS due FROM bookmarks")
def task_enqueue(spark, d):
    t = queues.new_tasks(adapt.bookmarks(spark, d).select("user_id", "url", "tags", "created_at"))
    return t.select("user_id", "url", "status", _joined("tags").alias("tags"), _at("created_at").alias("created_at"), _at("next_delivery").alias("due"))


@query(f"{with_views('chunks')} SELECT chunk_index, chunk_text AS summary FROM chunks WHERE user_id = '7' AND bookmark_id = '17' ORDER BY chunk_index")
def ai_chunks_of_bookmark(spark, d):
    c = adapt.chunks(spark, d).withColumn("summary", F.col("chunk_text"))
    return chunking.chunks_of(c, "7", "17").select("chunk_index", "summary")


@query(f"{with_views('sessions')} SELECT session_id, question, CASE WHEN session_id LIKE '%1-%' AND user_id <> '3' THEN 'late' END AS answer, CASE WHEN session_id LIKE '%1-%' AND user_id <> '3' THEN 'c1' ELSE '' END AS chunks FROM sessions")
def rag_session_lifecycle(spark, d):
    """Questions come first; answers come later and only reach a session of their own tenant."""
    s = adapt.sessions(spark, d)
    asked = history.opened(s.select("session_id", "user_id", "question"), NOW)
    answers = s.where("session_id LIKE '%1-%'").select("session_id", F.when(F.col("user_id") == "3", "other").otherwise(F.col("user_id")).alias("user_id"), F.lit("late").alias("answer"), F.array(F.lit("c1")).alias("relevant_chunks"))
    return history.answered(asked, answers, NOW).select("session_id", "question", "answer", _joined("relevant_chunks").alias("chunks"))


@query()
def bookmark_id_murmur(spark, d):
    return adapt.pages(spark, d).select("page_id", bookmark_id(canonical_url("url")).alias("bookmark_id"))


@query()
def html_article_text(spark, d):
    return adapt.pages(spark, d).select("page_id", H.title("html").alias("title"), M.article_text("html").alias("text"), M.article_html("html").alias("article"), M.sanitized("html").alias("sanitized"))


def _with_images(spark, d):
    """Pages with an image below the site's root and one beside the page."""
    extra = F.concat(F.lit('<img alt="x" src="/img/'), F.col("page_id").cast("string"), F.lit(".png\"><IMG SRC='pic.jpg?v=1'>"))
    return adapt.pages(spark, d).withColumn("html", F.concat("html", extra))


_WITH_IMAGES = "p AS (SELECT page_id, url, html || '<img alt=\"x\" src=\"/img/' || page_id || '.png\"><IMG SRC=''pic.jpg?v=1''>' AS html FROM pages)"


@query(f"WITH {_WITH_IMAGES} SELECT page_id, len(regexp_extract_all(html, '(?i)<img\\b[^>]*?\\ssrc\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) AS images FROM p")
def html_images(spark, d):
    return _with_images(spark, d).select("page_id", F.size(H.image_sources("html")).cast("long").alias("images"))


@query(f"""WITH o AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')) AS origin, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/(?:[^?#]*/)?)', 1) AS folder FROM pages)
SELECT page_id, '/img/' || page_id || '.png' AS src, origin || '/img/' || page_id || '.png' AS image_url FROM o UNION ALL SELECT page_id, 'pic.jpg?v=1', origin || CASE WHEN folder = '' THEN '/' ELSE folder END || 'pic.jpg?v=1' FROM o""")
def html_image_rows(spark, d):
    return readers.images(_with_images(spark, d)).select("page_id", "src", "image_url")


@query("SELECT page_id, count(*) AS images, bool_and(true) AS rewritten FROM (SELECT page_id, unnest([1, 2]) FROM pages) GROUP BY page_id")
def html_images_rewritten(spark, d):
    p = _with_images(spark, d)
    out = readers.rewritten_images(p, readers.images(p))
    links = F.regexp_count("html", F.lit('(?i)src="/static/[0-9]+/[A-Za-z0-9_-]{22}"'))
    return out.select("page_id", links.cast("long").alias("images"), (~F.col("html").contains('src="/img/')).alias("rewritten"))


# Chunks of texts

_TOKENS = "list_filter(string_split_regex(text_content, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
_WINDOWS = f"""{with_views("bookmarks")}, t AS (SELECT bookmark_id, user_id, {_TOKENS} AS t FROM bookmarks),
w AS (SELECT bookmark_id, user_id, t, unnest(generate_series(0, len(t) - 1, 40)) AS p0 FROM t WHERE len(t) > 0),
c AS (SELECT bookmark_id, user_id, CAST(p0 // 40 AS INTEGER) AS chunk_index, array_to_string(t[p0 + 1 : p0 + 50], ' ') AS chunk_text FROM w)"""
_CONFIG = chunking.ChunkConfig(50, 10)


@query(f"{_WINDOWS} SELECT bookmark_id, chunk_index, chunk_text FROM c")
def chunk_windows(spark, d):
    return chunking.windows(adapt.bookmarks(spark, d).select("user_id", "bookmark_id", "text_content"), _CONFIG).select("bookmark_id", "chunk_index", "chunk_text")


def _characters(text: str) -> list[int]:
    return list(map(ord, text))


def _from_characters(ids: list[int]) -> str:
    return "".join(map(chr, ids))


@query(f"""{with_views("bookmarks")}, w AS (SELECT bookmark_id, text_content, unnest(generate_series(0, length(text_content) - 1, 250)) AS p0 FROM bookmarks WHERE length(text_content) > 0)
SELECT bookmark_id, CAST(p0 // 250 AS INTEGER) AS chunk_index, substr(text_content, p0 + 1, 300) AS chunk_text FROM w""")
def chunk_token_windows(spark, d):
    """Windows over the ids of a codec: encoded, cut, decoded; here an id per character."""
    b = adapt.bookmarks(spark, d).select("user_id", "bookmark_id", "text_content")
    return chunking.token_windows(b, chunking.ChunkConfig(300, 50), _characters, _from_characters).select("bookmark_id", "chunk_index", "chunk_text")


@query(f"{_WINDOWS} SELECT bookmark_id, chunk_index, sha256(chunk_text) AS chunk_hash FROM c")
def chunk_hash(spark, d):
    return chunking.with_hash(chunking.windows(adapt.bookmarks(spark, d).select("user_id", "bookmark_id", "text_content"), _CONFIG)).select("bookmark_id", "chunk_index", "chunk_hash")


@query(f"{_WINDOWS} SELECT user_id, bookmark_id, bool_and(NOT (CAST(bookmark_id AS BIGINT) % 3 = 0 AND chunk_index = 1)) AND CAST(bookmark_id AS BIGINT) % 5 <> 0 AS valid FROM c GROUP BY user_id, bookmark_id")
def chunk_cache_validity(spark, d):
    fresh = chunking.with_hash(chunking.windows(adapt.bookmarks(spark, d).select("user_id", "bookmark_id", "text_content"), _CONFIG))
    n = F.col("bookmark_id").cast("long")
    changed = F.when((n % 3 == 0) & (F.col("chunk_index") == 1), F.lit("other")).otherwise(F.col("chunk_hash"))
    stored = fresh.withColumns({"chunk_hash": changed, "pipeline_version": F.when(n % 5 == 0, 1).otherwise(2)})
    return chunking.cache_validity(fresh, stored, 2)


@query(f"{with_views('bookmarks')} SELECT bookmark_id, length(text_content) >= 200 AS by_chars, strlen(text_content) >= 200 AS by_bytes FROM bookmarks")
def embeddable_chars_vs_bytes(spark, d):
    return adapt.bookmarks(spark, d).select("bookmark_id", predicates.long_enough().alias("by_chars"), predicates.long_enough(unit="bytes").alias("by_bytes"))


# Changes of tables


@query(f"{with_views('bookmarks')} SELECT CAST(doc_id % 4 AS VARCHAR) AS user_id, domain, count(*) AS n FROM bookmarks GROUP BY doc_id % 4, domain HAVING count(*) > 1")
def canonical_collisions(spark, d):
    b = adapt.bookmarks(spark, d).select((F.col("doc_id") % 4).cast("string").alias("user_id"), F.concat(F.lit("https://"), F.upper("domain"), F.lit(":443#x")).alias("url"))
    return mutations.collisions(b).select("user_id", domain("canonical_url").alias("domain"), "n")


@query(f"""{with_views("bookmarks")}, u AS (SELECT *, 'https://' || domain || '/' || (doc_id % 300) AS address FROM bookmarks),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, address ORDER BY created_at) AS n FROM u WHERE doc_id >= 100)
SELECT user_id, address, bookmark_id AS old_id FROM r WHERE n = 1 AND (user_id, address) NOT IN (SELECT (user_id, address) FROM u WHERE doc_id < 100)""")
def save_dedup_first_wins(spark, d):
    b = adapt.bookmarks(spark, d)
    b = b.withColumns({"old_id": F.col("bookmark_id"), "url": F.concat(F.lit("HTTPS://"), F.upper("domain"), F.lit(":443/"), (F.col("doc_id") % 300).cast("string"))})
    accepted, _ = mutations.new_bookmarks(b.where("doc_id < 100"), b.where("doc_id >= 100").drop("bookmark_id"))
    return accepted.select("user_id", F.col("canonical_url").alias("address"), "old_id")


@query(f"{with_views('bookmarks', 'chunks')} SELECT bookmark_id FROM bookmarks WHERE length(text_content) >= 200 AND bookmark_id NOT IN (SELECT bookmark_id FROM chunks)")
def bookmarks_without_chunks(spark, d):
    return adapt.bookmarks(spark, d).where(predicates.long_enough()).join(adapt.chunks(spark, d), ["user_id", "bookmark_id"], "left_anti").select("bookmark_id")


@query(f"{with_views('bookmarks', 'chunks')} SELECT 'bookmarks' AS name, user_id, bookmark_id FROM bookmarks WHERE doc_id % 3 <> 0 UNION ALL SELECT 'chunks', user_id, bookmark_id FROM chunks WHERE CAST(bookmark_id AS BIGINT) % 3 <> 0")
def delete_cascade(spark, d):
    b, c = adapt.bookmarks(spark, d), adapt.chunks(spark, d)
    left = mutations.delete_cascade({"bookmarks": b, "chunks": c}, b.where("doc_id % 3 = 0"), ["user_id", "bookmark_id"])
    parts = [df.select(F.lit(name).alias("name"), "user_id", "bookmark_id") for name, df in left.items()]
    return parts[0].unionByName(parts[1])


@query(f"{with_views('bookmarks')} SELECT bookmark_id, array_to_string(CASE WHEN doc_id % 2 = 0 THEN ['new', 'x'] ELSE tags END, '|') AS tags FROM bookmarks")
def update_tags_set(spark, d):
    b = adapt.bookmarks(spark, d)
    changes = b.where("doc_id % 2 = 0").select("user_id", "bookmark_id", F.array(F.lit(" New "), F.lit("new"), F.lit("x"), F.lit(" ")).alias("new_tags"))
    return mutations.update_tags(b, changes).select("bookmark_id", _joined("tags").alias("tags"))


@query(f"{with_views('bookmarks')} SELECT bookmark_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'short' ELSE summary END AS summary FROM bookmarks")
def update_summary(spark, d):
    b = adapt.bookmarks(spark, d)
    changes = b.where("doc_id % 2 = 0").select("user_id", "bookmark_id", F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).otherwise(F.lit("short")).alias("new_summary"))
    return mutations.update_summary(b, changes).select("bookmark_id", "summary")


@query(f"{with_views('chunks')} SELECT bookmark_id, chunk_index, CASE WHEN vec_id % 200 < 20 THEN 'anew' ELSE chunk_text END AS chunk_text FROM chunks WHERE vec_id % 200 >= 20 OR chunk_index = 0")
def replace_chunks(spark, d):
    c = adapt.chunks(spark, d)
    new = c.where("vec_id % 200 < 20 AND chunk_index = 0").withColumn("chunk_text", F.lit("anew"))
    return mutations.replace_chunks(c, new).select("bookmark_id", "chunk_index", "chunk_text")


@query("SELECT c_custkey, lower(trim(c_name)) AS name FROM (SELECT *, row_number() OVER (PARTITION BY lower(c_name) ORDER BY c_custkey) AS n FROM customer) WHERE n = 1 AND lower(c_name) NOT IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 10 = 3)")
def users_unique_names(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit(" "), F.upper("c_name")).alias("username"), F.col("c_custkey").alias("user_id"), F.lit(0).alias("created_at"))
    return mutations.new_users(c.where("c_custkey % 10 = 3"), c).select("c_custkey", F.lower(F.trim("username")).alias("name"))


# Windows of text-free tables: the general helpers on other tables


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def latest_wins_topk(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return mutations.first_of(o, ["o_custkey"], F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"{with_views('bookmarks')} SELECT bookmark_id, CAST(len({_WORDS.format('text_content')}) AS INTEGER) AS words FROM bookmarks")
def word_counts(spark, d):
    return adapt.bookmarks(spark, d).select("bookmark_id", F.size(words("text_content")).alias("words"))


@query()
def english_lexemes(spark, d):
    return adapt.bookmarks(spark, d).select("bookmark_id", F.array_join(F.filter(lexemes("title"), lambda x: x != ""), " ").alias("lexemes"))




# Enrichment with a stand-in model, versions of the model


def _embed(texts: list[str]) -> list[list[float]]:
    """Stand-in embedder: letter counts."""
    return [[float(t.count(c)) for c in "aeiou"] for t in texts]


@query(f"{_WINDOWS} SELECT bookmark_id, chunk_index, CAST(length(chunk_text) - length(replace(chunk_text, 'e', '')) AS DOUBLE) AS e FROM c")
def chunk_embeddings(spark, d):
    chunks = chunking.windows(adapt.bookmarks(spark, d).select("user_id", "bookmark_id", "text_content"), _CONFIG)
    return enrich.embedded(chunks, _embed).select("bookmark_id", "chunk_index", F.element_at("embedding", 2).cast("double").alias("e"))


@query(f"""{_WINDOWS}, a AS (SELECT user_id, bookmark_id, chunk_index, CASE WHEN CAST(bookmark_id AS BIGINT) % 2 = 0 THEN 'stored' ELSE string_split(chunk_text, ' ')[1] END AS summary, string_split(chunk_text, ' ')[1] AS tag FROM c)
SELECT bookmark_id, string_agg(summary, chr(10) ORDER BY chunk_index) AS summaries FROM a GROUP BY bookmark_id""")
def chunk_analysis_with_memo(spark, d):
    fresh = enrich.chunk_rows(adapt.bookmarks(spark, d), _CONFIG)
    even = F.col("bookmark_id").cast("long") % 2 == 0
    stored = fresh.select("user_id", "bookmark_id", "chunk_index", "chunk_hash", F.when(even, 1).otherwise(0).alias("pipeline_version"), F.lit("stored").alias("summary"), F.array(F.lit("s")).alias("tags"))
    done = enrich.analyzed(fresh, stored, lambda text: (text.split(" ")[0], [text[:1]]), 1)
    return enrich.consolidated(done).select("bookmark_id", "summaries")


@query(f"{with_views('bookmarks')} SELECT bookmark_id, array_to_string(list_sort(list_distinct(list_transform(tags, lambda t: lower(t)))), '|') AS tags FROM bookmarks WHERE len(tags) > 0")
def migrated_tags(spark, d):
    b = adapt.bookmarks(spark, d).withColumn("tags", F.transform("tags", lambda t: F.concat(F.lit(" "), F.upper(t))))
    return versions.lower_case_tags(b).where("tags is not null").select("bookmark_id", _joined("tags").alias("tags"))


@query(f"{with_views('bookmarks')} SELECT bookmark_id, CASE WHEN length(text_content) >= 200 THEN 'pending' ELSE 'done' END AS embedding_status, 'pending' AS text_ai_status, true AS cleared FROM bookmarks")
def migration_reset(spark, d):
    tables = versions.reset_derived({"bookmark": _with_state(spark, d), "bookmark_chunk": adapt.chunks(spark, d)}, NOW)
    return tables["bookmark"].select("bookmark_id", "embedding_status", "text_ai_status", (F.col("tags").isNull() & F.col("summary").isNull()).alias("cleared"))


@query("SELECT max(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS version FROM orders")
def schema_version(spark, d):
    """Orders as applied changes, their priority as the version of each."""
    applied = spark.read.parquet(f"{d}/orders.parquet").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("version"))
    return spark.range(1).select(F.lit(versions.current(applied)).cast("int").alias("version"))


@query("SELECT c_custkey FROM customer WHERE lower(c_name) = (SELECT lower(min(c_name)) FROM customer)")
def user_by_name(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    name = c.agg(F.min("c_name")).first()[0]
    return versions.user_named(c.withColumnRenamed("c_name", "username"), f"  {name.upper()} ").select("c_custkey")


@query(f"{with_views('sessions')} SELECT session_id, question, answer FROM sessions WHERE user_id = '3' AND session_id = (SELECT min(session_id) FROM sessions WHERE user_id = '3')")
def rag_session_by_id(spark, d):
    s = adapt.sessions(spark, d).where("user_id = '3'")
    first = s.agg(F.min("session_id")).first()[0]
    return s.where(F.col("session_id") == first).select("session_id", "question", "answer")


@query(f"{with_views('chunks')} SELECT bookmark_id, chunk_index, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS summary FROM chunks")
def upsert_ai_chunks(spark, d):
    old = adapt.chunks(spark, d).select("user_id", "bookmark_id", "chunk_index", F.lit("old").alias("summary"), "vec_id")
    new = old.where("vec_id % 2 = 0").withColumn("summary", F.lit("new"))
    return mutations.upsert(old, new, ["user_id", "bookmark_id", "chunk_index"]).select("bookmark_id", "chunk_index", "summary")


@query(f"{with_views('bookmarks')} SELECT bookmark_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'made' END ELSE summary END AS summary, array_to_string(CASE WHEN doc_id % 5 = 0 THEN ['a'] ELSE tags END, '|') AS tags FROM bookmarks")
def ai_output_merge(spark, d):
    b = adapt.bookmarks(spark, d).withColumns({"new_summary": F.when(F.col("doc_id") % 4 == 0, F.lit(" ")).otherwise(F.lit("made")), "new_tags": F.array(F.lit(" A"), F.lit("a")), "needs_summary": F.col("doc_id") % 2 == 0, "needs_tags": F.col("doc_id") % 5 == 0, "has_chunks": F.lit(True)})
    return mutations.ai_output(b).select("bookmark_id", "summary", _joined("tags").alias("tags"))


@query(f"{with_views('bookmarks')} SELECT count(DISTINCT bookmark_id) AS n, 10 AS drawn, 10 AS of_them FROM bookmarks WHERE length(text_content) >= 200")
def random_bookmarks(spark, d):
    """A draw has no fixed rows; what holds for any: ten different bookmarks, all of them long enough."""
    b = adapt.bookmarks(spark, d)
    long = b.where(predicates.long_enough())
    drawn = long.select("bookmark_id", F.rand().alias("r")).orderBy("r", "bookmark_id").limit(10)
    facts = drawn.join(b, "bookmark_id").agg(F.count_distinct("bookmark_id").cast("int").alias("drawn"), F.count_if(predicates.long_enough()).cast("int").alias("of_them"))
    return long.agg(F.count_distinct("bookmark_id").alias("n")).crossJoin(facts)


@query(f"{with_views('tasks')} SELECT {_AT.format("date_trunc('hour', created_at)")} AS start, status, count(*) AS n FROM tasks GROUP BY 1, 2")
def task_facets_by_hour(spark, d):
    return queue_stream.facets_by_time(adapt.tasks(spark, d)).select(_at("start").alias("start"), "status", "n")
