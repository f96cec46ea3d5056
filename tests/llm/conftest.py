"""Tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet " * 8000


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        (1, "the same text here", "en"), (2, "the same  text\there", "en"), (3, "another text", None), (3, "another text", None), (4, None, "fr"), (5, "", "en"), (6, "   \n ", "en"),
        (None, "the same text here", "en"), (None, None, None), (7, LONG, "en"), (8, LONG + "x", "en"), (9, "été là où ça ¡12 €", "fr"), (10, "12 34 !!", "en"), (11, "a", "fr"), (11, "b", "fr"),
        (12, "<|endoftext|> <s> ▁x", "en"), (13, "日本語 текст", None), (-5, "the same text here", "en"),
    ]
    full = [(*r, "d", 1, 2, "k", 3, "h") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, digest string, batch int, fp int, `key` string, bucket int, _text string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
