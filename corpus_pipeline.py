"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before kept. All but the
last return the columns of `documents`; further columns are left out. Null ids, languages and sources stay as they are, and
a null source is a source of its own. An empty table gives an empty result in every stage. Texts are worked on whole.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402

from stowage.llm import mixing, packing, quality, secret_scan, simhash  # noqa: E402
from stowage.llm.queries import BYTE_MODEL, table  # noqa: E402
from stowage.session import materialize, ship_package  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier takes for good stay; null texts are judged as empty ones. Repeated rows are
    judged alike, so all of them stay or go."""
    return quality.keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays, once if its row is repeated.

    Null and empty texts are duplicates of each other. A row of a null id stays, once per text: it cannot be told from others.
    """
    ship_package(spark)
    return simhash.keep_one(docs.select(COLUMNS))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in its text are replaced by a mark, n_chars follows. A null text stays null."""
    clean = secret_scan.redact_secrets(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document is repeated up to three times, or left out. Null and empty
    texts, which have no words, stay once."""
    return mixing.mixed(docs.select(COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024; a null or empty text is a piece of its end token alone.
    Repeated rows are packed as often as they occur."""
    ship_package(spark)
    return packing.pack_documents(docs.select(COLUMNS), public_tokenizers.path(BYTE_MODEL))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: the classifier, the fingerprints and the tokenizer cannot be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
