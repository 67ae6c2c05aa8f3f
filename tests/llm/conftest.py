"""Documents with the cases that every operator must bear: nulls, empty and very long texts, copies."""

from __future__ import annotations

import pytest
from llm_texts import prose

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, Host string, evidence double, contamination string, secrets string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, repeated rows and ids, an empty and a very long text, clashing column names."""
    long = prose(1, 30000)
    rows = [(1, "", "en", "a"), (2, None, None, None), (3, long, "en", "a"), (4, long, "en", "a"), (4, long, "en", "a"), (None, "no id here", "en", "b"), (None, None, "fr", "b"), (7, "ümläut 漢字 🙂 one", "de", "a"), (8, " \n\t ", "en", "a")]
    return spark.createDataFrame([(*r, len(r[1] or ""), None, 0.5, "x", "y") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
