"""Registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, language, lexical, licenses, merkle, mixing, near_dedup, perspectives, quality, substrings, surrogates, toxicity
from .common import SPACE, read

EXACT_SQL = f"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM t"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(table: str, op: Callable[..., DataFrame], *more: str):
        return lambda spark, sf_dir: op(read(spark, sf_dir, table), *[read(spark, sf_dir, t) for t in more])

    return {
        "op1_license_scan": lambda spark, sf_dir: licenses.scan(read(spark, sf_dir, "documents")).drop("spans"),
        "op2_substring_dedup": over("documents", substrings.substring_dedup),
        "op3_quality_rules": over("documents", quality.quality),
        "op4_source_mixing": over("documents", mixing.mix_report),
        "op5_toxicity": over("documents", toxicity.toxicity, "labels"),
        "op6_near_dedup": lambda spark, sf_dir: near_dedup.near_dedup(read(spark, sf_dir, "documents"), n=4),
        "op7_bpe": over("documents", bpe.bpe),
        "op8_surrogates": over("documents", surrogates.surrogates),
        "op9_perspectives": over("conversations", perspectives.perspectives),
        "op10_exact_dedup": over("documents", exact_dedup.exact_dedup),
        "op11_language_id": over("documents", language.language),
        "op12_merkle_manifest": over("documents", merkle.merkle),
        "op13_lexical_search": over("documents", lexical.search, "benchmark"),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op1_license_scan": licenses.scan_sql(), "op9_perspectives": perspectives.SQL, "op10_exact_dedup": EXACT_SQL, "op12_merkle_manifest": merkle.SQL, "op13_lexical_search": lexical.SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql is not None}
