"""Cutting the lineage of iterative operators in files that every executor can reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from a checkpoint in the shared folder that ``spark.checkpoint.dir`` names.

    Where none is named, a temporary folder in local mode, as in tests; on a cluster an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerloom-"))
    return df.checkpoint()
