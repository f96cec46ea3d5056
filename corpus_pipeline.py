"""From documents to packed sequences.

STAGES holds the stages in order. Each takes (spark, docs, sf_dir), works on all rows that the stage
before it kept and returns what it keeps; the result is written as Parquet and read again as the
next one's docs. All but the last keep the columns of documents. The models are fitted on the
stage's own input, so a stage can be run by itself. Every stage takes nulls in any column, repeated rows, further columns and empty
tables, which give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import exact_dedup, language_id, packing, quality, similar
from corpusmill.llm.common import stored, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null texts among them, and those of which no learned language has half of the letters. Repeated rows go or stay alike."""
    return language_id.in_a_language(docs, language_id.fit(docs.where(~language_id.held_out())))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects. Null and empty texts have the score of the offset alone; without labels nothing is learned and nothing goes."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    return quality.of_quality(docs, quality.fit(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but one of equal texts: the row of the smallest doc_id stays. Rows that repeat doc_id and text stay or go together."""
    return exact_dedup.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but one of each group of near-duplicates, links of SimHash and of min-hash bands with a 5-word similarity of 0.8 or more. Rows without doc_id stay."""
    return similar.without_similar(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row per piece. A null or empty text is a piece of one token."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Language and quality models and fingerprints are not for SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
