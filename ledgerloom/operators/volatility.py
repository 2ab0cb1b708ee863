"""Trades under regimes of a volatility index: cells, heat map, correlation, best bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .market import daily


def regime(close: Column, low: float = 15.0, high: float = 25.0) -> Column:
    return F.when(close < low, "Low").when(close <= high, "Medium").otherwise("High")


def with_regime(trades: DataFrame, market: DataFrame) -> DataFrame:
    """Trades of days with a close, and its regime."""
    return trades.withColumn("date", F.to_date("entry_time")).join(market.select("date", "close", regime(F.col("close")).alias("regime")), "date")


def cells(trades: DataFrame, market: DataFrame, keys: list[str], min_trades: int = 3) -> DataFrame:
    """Of every cell the account with the best mean, with its means by regime.

    Fragility: how much of the mean in Low (or else Medium) is lost in High. Consistent: all regimes with enough trades gain.
    Accounts without a regime of enough trades do not take part.
    """
    p = F.col("profit_loss")
    by = with_regime(trades, market).groupBy(*keys, "account_name", "regime").agg(F.count("*").alias("n"), F.sum(p).alias("total"))
    mean = lambda r: F.max(F.when((F.col("regime") == r) & (F.col("n") >= min_trades), F.col("total") / F.col("n")))
    wide = by.groupBy(*keys, "account_name").agg((F.sum("total") / F.sum("n")).alias("mean"), mean("Low").alias("low"), mean("Medium").alias("medium"), mean("High").alias("high"))
    known = F.array_compact(F.array("low", "medium", "high"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("mean", 6)), "account_name"))
    best = wide.filter(F.size(known) > 0).withColumn("r", rank).filter("r = 1").drop("r")
    lost = lambda a: F.greatest(a - F.coalesce("high", F.lit(0.0)), F.lit(0.0)) / a
    fragility = F.when(F.col("low") > 0, lost(F.col("low"))).when(F.col("medium") > 0, lost(F.col("medium")))
    return best.withColumn("fragility", fragility).withColumn("consistent", F.forall(known, lambda x: x > 0)).withColumn("regimes", F.size(known))


def heat_map(trades: DataFrame, market: DataFrame, key: str = "hour") -> DataFrame:
    """Mean and win rate by hour and regime, and how far they are from those of all trades: one row of totals is joined."""
    t = with_regime(trades, market)
    p = F.col("profit_loss")
    measures = [F.avg(p).alias("mean"), F.avg((p > 0).cast("double")).alias("win_rate")]
    whole = t.agg(measures[0].alias("all_mean"), measures[1].alias("all_win_rate"))
    by = t.groupBy(key, "regime").agg(F.count("*").alias("n"), *measures).crossJoin(F.broadcast(whole))
    return by.select(key, "regime", "n", "mean", "win_rate", (F.col("mean") - F.col("all_mean")).alias("mean_delta"), (F.col("win_rate") - F.col("all_win_rate")).alias("win_rate_delta"))


def correlation(trades: DataFrame, market: DataFrame, min_days: int = 5) -> DataFrame:
    """By account: correlation and regression of daily profit on the close."""
    j = daily(trades).join(market, "date")
    return j.groupBy("account_name").agg(F.count("*").alias("days"), F.corr("close", "pnl").alias("correlation"), F.regr_slope("pnl", "close").alias("slope"), F.regr_intercept("pnl", "close").alias("intercept"), F.regr_r2("pnl", "close").alias("r2")).filter(F.col("days") >= min_days)


def best_band(trades: DataFrame, market: DataFrame, width: int = 4, step: int = 2, min_trades: int = 5) -> DataFrame:
    """By account the band [lo, lo + width) of the close with the best mean. A close is laid over the bands that hold it."""
    first = F.ceil((F.col("close") - width) / step + F.lit(1e-9))
    lows = F.sequence(F.greatest(first, F.lit(0)), F.floor(F.col("close") / step))
    t = trades.withColumn("date", F.to_date("entry_time")).join(market, "date").groupBy("account_name", "close").agg(F.sum("profit_loss").alias("total"), F.count("*").alias("n"))
    by = t.select("account_name", "total", "n", F.explode(lows).alias("k")).groupBy("account_name", "k").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n")).filter(F.col("n") >= min_trades)
    rank = F.row_number().over(Window.partitionBy("account_name").orderBy(F.desc(F.round("mean", 6)), "k"))
    return by.withColumn("r", rank).filter("r = 1").select("account_name", (F.col("k") * step).cast("long").alias("band_low"), "n", "mean")
