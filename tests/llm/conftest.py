import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text[, source]) rows, with a column that operators do not expect."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) + ("x",) * 3 for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, size string, token string")

    return make
