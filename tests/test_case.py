"""Upper and lower case of letters that have no single counterpart, against SQL."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pytest
from compare import same

import __spark_entry__  # noqa: F401  (registers the queries)
from corpusmill.plans import catalog

ODD = ["ßheit, | enkeit", "ŉa İstanbul", "ᾳ ΟΔΟΣ", "ﬁn ΟΔΟΣ, ΟΔΟΣ.", "ǰ", "ẞa", "ǆx"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(ODD)), pa.int64()), "text": ODD}))
    return path, con


def test_capitalize_normalize(spark, odd):
    same(catalog.QUERIES["capitalize_normalize"](spark, odd[0]).toPandas(), odd[1].sql(catalog.SQL["capitalize_normalize"]).df())


def test_preprocess_sentence(spark, odd):
    same(catalog.QUERIES["preprocess_sentence"](spark, odd[0]).toPandas(), odd[1].sql(catalog.SQL["preprocess_sentence"]).df())


def test_rare_spaces_and_newer_letters(spark, tmp_path):
    texts = [f"{c}ab {c} cd{c}" for c in "\x0b\x85\xa0\u2028\u019b\u0264\u1c8a\ua7cd\ua7db\ua7dc\U00010d50\U00010d70\U00010d85"]
    texts = ["\n".join(["x"] * (i % 3) + [t] * 3) for i, t in enumerate(texts)]
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", rows)
    same(catalog.QUERIES["preprocess_sentence"](spark, str(tmp_path)).toPandas(), con.sql(catalog.SQL["preprocess_sentence"]).df())
