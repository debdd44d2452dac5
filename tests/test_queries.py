"""Every registered query that has SQL gives what the SQL gives."""

import datetime
import decimal
import re

import duckdb
import pytest

from quarry.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


#: What rows of queries without SQL must be like.
SHAPES = {
    "fts_headline": lambda r: r["search_match"] is not None and len(r["search_match"].split()) <= 35,
    "fts_english_stem": lambda r: r["rank"] > 0,
    "knn_ivf_topk": lambda r: -1 <= r["similarity"] <= 1,
    "knn_index_batch": lambda r: -1 <= r["similarity"] <= 1 and r["recall"] >= 0.9,
    "bookmark_id_murmur": lambda r: r["bookmark_id"] is None or len(r["bookmark_id"]) == 22,
    "html_article_text": lambda r: not re.search(r"(?i)<(?:script|style|iframe)|\son\w+=|javascript:", r["sanitized"] + r["article"]),
    "english_lexemes": lambda r: r["lexemes"] == r["lexemes"].lower() and "  " not in r["lexemes"],
}


def test_every_query_has_sql_or_a_shape():
    assert set(QUERIES) - set(ORACLE) == set(SHAPES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name in SHAPES:
        assert rows and all(SHAPES[name](dict(zip(names, r, strict=True))) for r in rows)
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        at = [d[0] for d in found.description]
        assert sorted(at) == names
        assert rows == sorted((tuple(plain(r[at.index(c)]) for c in names) for r in found.fetchall()), key=repr)
