"""The pipeline's stages against brute force on what each stage gets."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from test_similar import brute_kept
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm import language_id, packing, quality
from corpusmill.llm.common import stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        results.append(docs.toPandas())
        if name != "packing":
            assert docs.columns == columns
    language, good, exact, near, pieces = results
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    said = language_id.predicted(whole, language_id.fit(whole.where(~language_id.held_out()))).toPandas()
    assert set(language.doc_id) == set(said.doc_id[(said.lang_pred != "und") & (said.score >= 0.5)])
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~quality.held_out())
    frame = spark.createDataFrame(language)
    scored = quality.scored(frame, quality.fit(frame, labels)).toPandas()
    assert set(good.doc_id) == set(scored.doc_id[scored.score >= 0.3])
    norm = good.assign(n=[re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in good.text])
    assert set(exact.doc_id) == set(norm.groupby("n").doc_id.min())
    assert set(near.doc_id) == set(brute_kept(list(zip(exact.doc_id, exact.text))))  # five words, similarity 0.8 or more
    tokenizer = Tokenizer.from_file(P.path(packing.VOCABULARY))
    assert set(pieces.doc_id) == set(near.doc_id) and pieces.sequence_id.is_unique
    texts = dict(zip(near.doc_id, near.text))
    for doc, part in pieces.groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[doc], add_special_tokens=False).ids + [1], "<u4")
        assert sorted(zip(part.start, part.ids_crc32)) == [(s, zlib.crc32(ids[s : s + n].tobytes())) for s, n in sorted(zip(part.start, part.length))]
        assert part.length.sum() == len(ids)


def test_clean_documents_stay(spark):
    """No labelled good document is lost to the filters, and the labelled bad ones go."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, corpus_pipeline.language_stage(spark, docs, sf), sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    good, bad = (set(labels.doc_id[labels.quality == q]) for q in (1, 0))
    assert len(good - set(kept.doc_id)) <= 0.01 * len(good) and len(bad & set(kept.doc_id)) <= 0.1 * len(bad)


def test_run_and_registration(spark, sf):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", q)[0] for q in __spark_entry__.queries() if re.match(r"op\d+_", q)}
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_odd_rows_go_through(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf), f"odd-{name}")
        assert "sequence_id" in docs.columns


@pytest.mark.parametrize(
    "name", ["op1_exact_dedup", "op2_language_id", "op3_token_counts", "op4_html_text", "op5_simhash", "op6_warc", "op7_top_k", "op8_packing", "op9_byte_bpe", "op10_quality", "op11_vector_codes", "op12_token_alignment", "op13_target_mix", "pipeline"]
)
def test_queries_over_empty_tables(spark, sf, tmp_path, name):
    import __spark_entry__

    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert __spark_entry__.queries()[name](spark, str(tmp_path)).count() == 0


def test_stored_tables_can_be_dropped(spark):
    from corpusmill.llm.common import drop_stored, new_folder

    rows = stored(spark.range(3), "x")
    assert rows.count() == 3 and rows.sparkSession.sparkContext.applicationId in new_folder(spark, "y")
    drop_stored(spark)
    drop_stored(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|not exist"):
        rows.count()
