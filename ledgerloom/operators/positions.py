"""Positions with average prices, as scans: no fill is handled one after another in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fills import BOOK
from .scans import affine, running


def ledger(fills: DataFrame) -> DataFrame:
    """Position, average price and realised points after every fill of a book (account, symbol, session).

    Adding to a position changes its cost by price times lots; reducing it scales the cost by the share that is left; a fill that
    opens, or turns the position over, starts a new cost with what is left of it. So a fill is an affine map of the cost, and
    positions and costs are scans over the hours of a book. The average price of a flat position is null.
    """
    hour = F.date_trunc("hour", F.col("ts"))
    order = ["ts", "fill_id"]
    q, pos, prev = F.col("q"), F.col("position"), F.col("prev")
    run = fills.withColumn("q", F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")).cast("long"))
    run = running(run, BOOK, order, hour, {"position": q}).withColumn("prev", pos - q)
    opens = (prev == 0) | (F.signum(prev) * F.signum(pos) < 0)
    grows = opens | (F.abs(pos) > F.abs(prev))
    scale = F.when(opens | (pos == 0), 0.0).when(grows, 1.0).otherwise(F.abs(pos) / F.nullif(F.abs(prev), F.lit(0)))
    added = F.when(opens, F.abs(pos)).when(grows, F.abs(q)).otherwise(0) * F.col("price")
    run = affine(run, BOOK, order, hour, scale, added).withColumnRenamed("value", "cost")
    run = run.withColumn("average_price", F.col("cost") / F.nullif(F.abs(pos), F.lit(0)))
    closed = F.when(F.signum(prev) * F.signum(q) < 0, F.least(F.abs(q), F.abs(prev))).otherwise(0)
    realised = F.coalesce(closed * (F.col("price") - F.col("value_before") / F.nullif(F.abs(prev), F.lit(0))) * F.signum(prev), F.lit(0.0))
    return run.withColumn("realised", realised).select("fill_id", *BOOK, "position", "average_price", "realised")


def once_across_files(fills: DataFrame, file_col: str, per_second: int = 2) -> DataFrame:
    """One fill of each bucket of time, price, side, quantity, account and note among all files; the first file by name keeps it."""
    bucket = F.bround(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 * per_second)
    w = Window.partitionBy("account", "symbol", "side", "quantity", "price", "note", "bucket").orderBy(file_col, "ts", "fill_id")
    return fills.withColumn("bucket", bucket).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "bucket")
