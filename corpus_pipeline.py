"""A corpus pipeline of five stages, each an operator of tidemark.llm over all that the stage before kept.

quality     documents that the adaptive quality rules reject go
near_dups   one document of each SimHash near-duplicate component stays, the one of the smallest doc_id
personal    personal data is replaced by its kind; n_chars follows the text
mix         documents are repeated or left out so that the sources meet their target shares
segments    every document as its best SentencePiece segmentation, with the scores of the N best

Every stage but the last returns the columns of documents. Each is written as Parquet and read again.
Nulls, empty and repeated rows, ties and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, nbest, pii, quality, simhash
from tidemark.llm.common import stage, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def segment_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nbest.segment(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dups", drop_near_duplicates),
    ("personal", mask_personal_data),
    ("mix", mix_sources),
    ("segments", segment_texts),
]

#: SQL has no SentencePiece segmentation; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
