"""Tab-separated activity logs and trade lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed formats of times in logs.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss"]


def whole_number(text: Column) -> Column:
    """Integers that may be written as 1,000 or 1.0; null for others."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double").try_cast("long")


def moment(text: Column) -> Column:
    """A time in any of the known formats; doubled blanks and the marks BP and EP are ignored."""
    tidy = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+(BP|EP)$", ""), r"\s+", " ")
    return F.coalesce(*[F.try_to_timestamp(tidy, F.lit(f)) for f in TIME_FORMATS])


def read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text. Short lines are padded with nulls, long ones cut; the header line is skipped."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\t")
    rows = lines.select(*[F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(columns)], F.input_file_name().alias("file"))
    return rows.filter(~F.coalesce(F.col(columns[0]) == columns[0], F.lit(False)))


def typed(rows: DataFrame, times: list[str], numbers: list[str], decimals: list[str]) -> DataFrame:
    """Typed columns, and ``problems``: the columns whose text could not be read. Bad rows are counted, not fatal."""
    made = {c: moment(F.col(c)) for c in times} | {c: whole_number(F.col(c)) for c in numbers} | {c: F.regexp_replace(F.trim(F.col(c)), "[,%]", "").try_cast("double") for c in decimals}
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & v.isNull(), F.lit(c)) for c, v in made.items()]))
    return rows.withColumn("problems", bad).withColumns(made)


def new_only(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not yet known, each once."""
    return incoming.dropDuplicates(keys).join(known.select(*keys).distinct(), keys, "left_anti")


def trade_key(*columns: str) -> Column:
    """A short deterministic key of a trade's signature."""
    return F.concat(F.lit("T"), F.substring(F.md5(F.concat_ws("_", *[F.col(c).cast("string") for c in columns])), 1, 12))
