"""One registered query per operator, over whole tables, and the SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stowage.llm import (
    collocations, filter_audit, fingerprints, jaccard, langid, mixing, neighbours, packing, quality, secret_scan, simhash, token_counts, warc,
)
from stowage.session import ship_package

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, folder, "documents"), public_tokenizers.path(PIECE_MODEL)
    )


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, folder, "documents"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(table(spark, folder, "pages"))


def op6_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, folder, "documents"), public_tokenizers.path(BYTE_MODEL)
    )


def op10_languages(spark: SparkSession, folder: str) -> DataFrame:
    found = langid.identify_languages(table(spark, folder, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_filters(spark, f"{folder}/documents.parquet", table(spark, folder, "labels"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES = (
    op1_token_counts, op2_secret_scan, op3_quality, op4_fingerprints, op5_warc,
    op6_mix, op7_simhash, op8_neighbours, op9_packing, op10_languages,
    op11_jaccard, op12_filter_audit, op13_collocations,
)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


def texts() -> dict[str, str]:
    return {
        "op5_warc": warc.ORACLE, "op11_jaccard": jaccard.ORACLE, "op12_filter_audit": filter_audit.ORACLE,
        "op13_collocations": collocations.ORACLE,
    }
