"""Folders of files: discovery, tables with merges and backups, exports, and a cleaner that goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def discovered(spark: SparkSession, folder: str, *, glob: str = "*", since: str | None = None, account: str | None = None) -> DataFrame:
    """path, name, file_date, length of the files of a folder and those below it, by name.

    A file's date is the YYYY-MM-DD in its name, else its time of modification. ``since`` (a date) and ``account`` (a part of the
    name, in any case) choose. Contents are not read.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    named = F.nullif(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")).try_cast("date")
    files = found.withColumn("name", name).withColumn("file_date", F.coalesce(named, F.to_date("modificationTime")))
    if since:
        files = files.filter(F.col("file_date") >= F.lit(since).cast("date"))
    if account:
        files = files.filter(F.contains(F.lower("name"), F.lit(account.lower())))
    return files.select("path", "name", "file_date", "length").orderBy("name", "path")


def merged(known: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``known`` with the rows of ``incoming``, which win where the keys are equal (null equals null). ``incoming`` has each key once."""
    same = [known[k].eqNullSafe(incoming[k]) for k in keys]
    return known.join(incoming, same, "left_anti").unionByName(incoming, allowMissingColumns=True)


def removed_with_backup(table: DataFrame, condition, backup: str, rest: str) -> DataFrame:
    """Write the rows that ``condition`` names to ``backup``, then all others (those it is null for, too) to ``rest``; returns the rest.

    The source is left alone, so a lost executor or a second run loses nothing; ``rest`` takes its place once it is whole.
    """
    doomed = F.coalesce(condition, F.lit(False))
    table.filter(doomed).write.parquet(backup)
    table.filter(~doomed).write.parquet(rest)
    return table.sparkSession.read.schema(table.schema).parquet(rest)


def exported(table: DataFrame, path: str, kind: str = "csv", files: int | None = None) -> None:
    """Write a table as csv (with a header line), json lines or parquet; ``files`` is the number of parts, by default one a partition."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"no export as {kind}: csv, json or parquet")
    out = (table if files is None else table.repartition(files)).write
    (out.option("header", "true") if kind == "csv" else out).format(kind).save(path)


def cleaned(
    spark: SparkSession, folder: str, schema: str, clean: Callable[[DataFrame], DataFrame], out: str, audit: str, checkpoint: str,
    *, value: str = "profit_loss", files_at_once: int = 50, change: float = 0.15, most: float = 10_000_000.0,
) -> StreamingQuery:
    """Clean the files of a folder that were not cleaned before, at most ``files_at_once`` at a time; a stopped run goes on from its checkpoint.

    ``clean`` gets the rows with their ``file`` and keeps that column. ``out`` receives the clean rows and ``audit`` one row a file: rows and sums of ``value``
    before and after, and ``flagged`` where the sum changes by more than ``change`` of it (of 500 at least) or passes ``most``.
    Each batch writes to a folder of its own number, so a batch that is run again replaces what it wrote.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = clean(batch)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        total = lambda df, s: df.groupBy("file").agg(F.count("*").alias(f"rows_{s}"), F.coalesce(F.sum(value), F.lit(0.0)).alias(f"sum_{s}"))
        kept = batch.sparkSession.read.schema(rows.schema).parquet(f"{out}/batch={number}")
        both = total(batch, "before").join(total(kept, "after"), "file", "left").fillna(0)
        moved = F.abs(F.col("sum_after") - F.col("sum_before")) / F.greatest(F.abs("sum_before"), F.lit(500.0))
        both.withColumn("flagged", (moved > change) | (F.abs("sum_after") > most)).write.mode("overwrite").parquet(f"{audit}/batch={number}")

    stream = spark.readStream.schema(schema).option("header", "true").option("maxFilesPerTrigger", files_at_once).csv(folder)
    return stream.withColumn("file", F.input_file_name()).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
