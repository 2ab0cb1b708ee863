"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, decontam, filter_audit, html_extract, langid, line_dedup, near_dedup, pii, quality_model, quality_rules, repeats, secrets
from .common import read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": lambda spark, d: near_dedup.near_duplicates(read(spark, d, "documents").select("doc_id", "text"), percent=85),
        "op2_quality_classifier": lambda spark, d: quality_model.quality_scores(read(spark, d, "documents"), read(spark, d, "labels")),
        "op10_html_extraction": lambda spark, d: html_extract.html_digest(read(spark, d, "pages")),
        "op3_quality_rules": lambda spark, d: quality_rules.quality_digest(read(spark, d, "documents")),
        "op4_language_id": lambda spark, d: langid.langid_digest(read(spark, d, "documents")),
        "op5_byte_bpe": lambda spark, d: bpe.bpe_digest(read(spark, d, "documents")),
        "op6_decontamination": lambda spark, d: decontam.decontam_digest(read(spark, d, "documents"), read(spark, d, "benchmark")),
        "op9_pii": lambda spark, d: pii.pii_digest(read(spark, d, "documents")),
        "op7_secret_scan": lambda spark, d: secrets.secrets_digest(read(spark, d, "documents")),
        "op8_suffix_repeats": lambda spark, d: repeats.repeats_digest(read(spark, d, "documents")),
        "op11_filter_audit": lambda spark, d: filter_audit.audit(read(spark, d, "documents"), read(spark, d, "labels")),
        "op12_line_dedup": lambda spark, d: line_dedup.line_digest(read(spark, d, "documents")),
        "op13_conversation_repair": lambda spark, d: conversations.repair_digest(read(spark, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.ORACLE,
        "op6_decontamination": decontam.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
        "op12_line_dedup": line_dedup.ORACLE,
    }
