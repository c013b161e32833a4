import re

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text) or (doc_id, text, lang, source) as documents, with a column that clashes with inner names."""

    def make(rows, extra=True):
        full = [(r[0], r[1], *(r[2:] or ("en", "a")), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "1 AS id", "2 AS n", "'x' AS name", "'y' AS key", "0 AS size", "0 AS copies") if extra else df

    return make


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
