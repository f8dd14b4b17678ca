from __future__ import annotations

import pytest
from shopsight.llm.common import prepare

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) or (doc_id, text, lang, source) rows."""
    prepare(spark)

    def make(rows):
        rows = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    return docs_of(
        [
            (1, None, None, None),
            (2, "", "en", "a"),
            (3, " \n\t ", "en", "a"),
            (4, "one two", "en", "a"),
            (4, "one two", "en", "a"),
            (5, long_text, "de", None),
            (6, "One TWO\nthree | four!", None, "b"),
            (None, "text without an id", "en", "b"),
            (7, "x" * 20_000, "en", "b"),
            (8, "été 漢字 \U0001f642 <|endoftext|> &amp;", "fr", "b"),
        ]
    )
