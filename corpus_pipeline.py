"""The corpus pipeline: documents through five stages, each reading all that the one before kept."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlens import session  # noqa: E402
from fleetlens.llm import bpe_automaton, decontaminate, language_id, ngram_join, secret_scan  # noqa: E402
from fleetlens.llm.frames import BATCH_BYTES, BATCH_KEY, cut, table  # noqa: E402

#: Words of an n-gram, and the similarity in hundredths from which the pipeline takes two documents for one.
DUPLICATE_WORDS, DUPLICATE_SIMILAR = 5, 80
#: SQL can't express the trained models of the first stage, the joins of sets or the encoding.
ORACLE_SQL = None


def configure(spark: SparkSession) -> None:
    """The session's settings, and batches of texts of BATCH_BYTES: a stage is run by whoever writes what it returns, so the setting stays."""
    session.configure(spark).conf.set(BATCH_KEY, BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    configure(spark)
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies (0.8 of their 5-word n-grams): the one with the smallest doc_id."""
    configure(spark)
    return ngram_join.keep_one(docs, DUPLICATE_WORDS, DUPLICATE_SIMILAR)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    configure(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    configure(spark)
    return secret_scan.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and a digest of what they decode to."""
    import public_tokenizers

    configure(spark)
    return bpe_automaton.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
