"""The corpus pipeline: from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept:

1. ``quality_rules``: lines that fail go, documents that lose too much or fail the base rules go;
2. ``near_dedup``: of every group of near-duplicates (similarity 0.8 or more) the document with the smallest id stays;
3. ``decontamination``: documents that hold ten consecutive words of a benchmark item go;
4. ``pii``: personal data is replaced by its kind;
5. ``byte_bpe``: texts become token ids; decoding is checked by a digest.

All but the last return the columns of ``documents``. SQL cannot express near-duplicates, redaction and encoding, so there is
no SQL for the whole; the tests hold it against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontam, near_dedup, pii, quality_rules
from ledgerloom.llm.common import stored


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.rejected_removed(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, percent=80)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def _byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    done = bpe.encoded_and_checked(docs, path, pattern, keep=["doc_id", "lang", "source"])
    return done.select(*[F.col("row")[c].alias(c) for c in ("doc_id", "lang", "source")], "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("quality_rules", _rules), ("near_dedup", _near_dedup), ("decontamination", _decontamination), ("pii", _pii), ("byte_bpe", _byte_bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next reads it, so none is done twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
