"""Exported or pasted lists of trades: encodings, headers of any order, typed rows, and a preview against what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .activity_log import moment, whole_number

#: Words of a header that name a column, and the place of the column in lists without a header. Fixed values.
COLUMNS = {
    "symbol": (("symbol",), 0),
    "trade_type": (("trade type",), 1),
    "entry_time": (("entry datetime",), 2),
    "exit_time": (("exit datetime",), 4),
    "entry_price": (("entry price",), 3),
    "exit_price": (("exit price",), 5),
    "quantity": (("trade quantity", "quantity"), 6),
    "profit_loss": (("profit/loss (c)", "profit/loss", "p/l"), 9),
    "commission": (("commission (c)", "commission"), 11),
    "note": (("note",), 13),
    "duration": (("duration",), 25),
    "account": (("account",), None),
}


def decoded(content: Column) -> Column:
    """Text of a file's bytes: UTF-16 or UTF-8 by its mark, else UTF-8 if it is valid, else one byte a character."""
    starts = lambda mark: F.hex(F.substring(content, 1, len(mark) // 2)) == mark
    plain = F.decode(content, "ISO-8859-1")
    utf8 = F.decode(F.when(F.is_valid_utf8(content.cast("string")), content), "UTF-8")
    text = F.when(starts("FFFE") | starts("FEFF"), F.decode(F.when(starts("FFFE") | starts("FEFF"), content), "UTF-16")).otherwise(F.coalesce(utf8, plain))
    return F.regexp_replace(text, "^﻿", "")


def files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``text`` of every file of a folder or pattern. A list is held whole in a row, as it is one export."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("file"), decoded(F.col("content")).alias("text"))


def pasted(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("pasted", text)], "file string, text string")


def _money(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[$,%]", "").try_cast("double")


def trades(texts: DataFrame) -> DataFrame:
    """One row per line of each text with two fields or more: ``file``, ``line``, the typed columns, and ``problems`` (columns whose text
    can't be read, and ``symbol``, ``entry_time`` where they are missing).

    The first line is a header if it names a symbol column; then columns are found by name, the first field that holds one of its
    words, and those it does not name are null. Lists without a header have the usual places. The account is its column's if that is
    no number, else what stands in brackets after the symbol.
    """
    kept = F.filter(F.split("text", r"\r\n|\n|\r"), lambda x: F.length(F.trim(x)) > 0)
    rows = texts.select("file", kept.alias("lines")).withColumn("header", F.transform(F.split(F.lower(F.coalesce(F.get("lines", F.lit(0)), F.lit(""))), "\t"), lambda x: F.trim(x)))
    named = F.exists("header", lambda x: x.contains("symbol")) & (F.size("header") > 1)

    def place(words: tuple[str, ...], usual: int | None) -> Column:
        holds = F.transform("header", lambda x: F.greatest(*[x.contains(w) for w in words], F.lit(False)))
        at = F.when(named, F.nullif(F.array_position(holds, True), F.lit(0)) - 1)
        return F.when(named, at).otherwise(F.lit(usual)).cast("int")

    rows = rows.withColumns({f"_{c}": place(*how) for c, how in COLUMNS.items()}).withColumn("first", F.when(named, 2).otherwise(1))
    lines = rows.select("*", F.posexplode(F.slice("lines", F.col("first"), F.greatest(F.size("lines") - F.col("first") + 1, F.lit(0)))).alias("i", "value")).withColumn("fields", F.split("value", "\t")).filter(F.size("fields") > 1)
    text = {c: F.nullif(F.trim(F.get("fields", F.col(f"_{c}"))), F.lit("")) for c in COLUMNS}
    raw = lines.select("file", (F.col("i") + F.col("first")).alias("line"), *[v.alias(c) for c, v in text.items()])
    bracket = F.nullif(F.regexp_extract("symbol", r"\(([^)]*)\)", 1), F.lit(""))
    clock = F.regexp_extract("duration", r"^(?:(\d+)d)?\s*(\d+):(\d+):(\d+)$", 0)
    part = lambda k: F.coalesce(F.regexp_extract("duration", r"^(?:(\d+)d)?\s*(\d+):(\d+):(\d+)$", k).try_cast("long"), F.lit(0))
    typed = {
        "entry_time": moment(F.col("entry_time")),
        "exit_time": moment(F.col("exit_time")),
        **{c: _money(F.col(c)) for c in ("entry_price", "exit_price", "profit_loss", "commission")},
        "quantity": whole_number(F.col("quantity")),
        "duration": F.when(clock != "", part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)),
    }
    side = F.when(F.upper("trade_type").rlike("LONG|BUY"), "LONG").when(F.col("trade_type").isNotNull(), "SHORT")
    bad = [F.when(F.col(c).isNotNull() & v.isNull(), F.lit(c)) for c, v in typed.items()] + [F.when(F.col(c).isNull(), F.lit(c)) for c in ("symbol", "entry_time")]
    return raw.select(
        "file", "line", F.trim(F.regexp_replace("symbol", r"\(.*", "")).alias("symbol"),
        F.coalesce(F.when(F.col("account").try_cast("double").isNull() & ~F.coalesce(F.col("account").endswith("%"), F.lit(False)), F.col("account")), bracket).alias("account"),
        side.alias("side"), *[v.alias(c) for c, v in typed.items()], "note", F.array_compact(F.array(*bad)).alias("problems"),
    )


def preview(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """One row: lines read, lines with problems, and of the good ones how many are new and how many repeat each other or are known."""
    good = found.filter(F.size("problems") == 0)
    fresh = good.select(*keys).distinct().join(known.select(*keys).distinct(), keys, "left_anti")
    new = fresh.agg(F.count("*").alias("new"))
    return found.agg(F.count("*").alias("lines"), F.count_if(F.size("problems") > 0).alias("with_problems")).crossJoin(F.broadcast(new)).withColumn("duplicates", F.col("lines") - F.col("with_problems") - F.col("new"))
