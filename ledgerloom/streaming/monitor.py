"""Streaming monitors over trades: event-time windows with watermarks; the same code runs on a finished table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _pnl() -> Column:
    return F.col("profit_loss")



def timed(trades: DataFrame) -> DataFrame:
    """Event time as a timestamp, which watermarks need."""
    return trades.withColumn("event_time", F.col("entry_time").cast("timestamp"))


def snapshots(trades: DataFrame, size: str = "24 hours", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sliding measures of every account and symbol."""
    t = timed(trades)
    t = t.withWatermark("event_time", late) if t.isStreaming else t
    g = t.groupBy(F.window("event_time", size, slide).alias("w"), "account_name", "symbol")
    return g.agg(F.count("*").alias("n"), F.sum(_pnl()).alias("total"), F.sum(F.when(_pnl() > 0, 1).otherwise(0)).alias("wins")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "account_name", "symbol", "n", "total", (F.col("wins") / F.col("n")).alias("win_rate"))


def sessions(trades: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of trading: session windows."""
    t = timed(trades)
    t = t.withWatermark("event_time", late) if t.isStreaming else t
    g = t.groupBy(F.session_window("event_time", gap).alias("w"), "account_name")
    return g.agg(F.count("*").alias("n"), F.sum(_pnl()).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "account_name", "n", "total")


def alerts(snaps: DataFrame, min_trades: int = 5, min_win_rate: float = 0.3, max_loss: float = 200.0) -> DataFrame:
    """Snapshots that break a limit, with the worst severity."""
    critical = F.col("total") < -2 * max_loss
    warning = (F.col("total") < -max_loss) | (F.col("win_rate") < min_win_rate)
    return snaps.filter(F.col("n") >= min_trades).withColumn("severity", F.when(critical, "CRITICAL").when(warning, "WARNING")).filter("severity is not null")


def once(fills: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Drops repeats of a key that arrive within the watermark."""
    t = fills.withColumn("event_time", F.col("ts").cast("timestamp"))
    return t.withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys) if t.isStreaming else t.dropDuplicates(keys)
