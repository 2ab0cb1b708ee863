"""Slot recommendation: which account trades a half-hour slot of a weekday best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import normal_cdf

CELL = ["symbol", "slot", "dow"]


def as_of(trades: DataFrame) -> DataFrame:
    """One row: the latest entry, which stands for now."""
    return trades.agg(F.max("entry_time").alias("now"))


def fresh(trades: DataFrame, days: int) -> DataFrame:
    """Trades of accounts that traded within ``days`` of the latest entry: a semi-join against a row an account, from which the latest
    entry of all is taken, too."""
    last = trades.groupBy("account_name").agg(F.max("entry_time").alias("last"))
    recent = last.crossJoin(F.broadcast(last.agg(F.max("last").alias("now"))))
    keep = recent.filter(F.col("last") >= F.col("now") - F.make_dt_interval(days=F.lit(days))).select("account_name")
    return trades.join(keep, "account_name", "left_semi")


def profit_factor(pnl: Column, sentinel: float) -> Column:
    gain, loss = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl <= 0, pnl))
    return F.when(F.coalesce(F.abs(loss), F.lit(0.0)) > 0, F.coalesce(gain, F.lit(0.0)) / F.abs(loss)).otherwise(F.lit(sentinel))


def slot_stats(trades: DataFrame, min_trades: int = 3, sentinel: float = 99.0, keys: list[str] | None = None) -> DataFrame:
    """Fourteen measures of every account and cell with enough trades, in one aggregation."""
    pnl = F.col("profit_loss")
    n = F.count("*")
    return (
        trades.groupBy("account_name", *(keys or CELL))
        .agg(
            n.alias("n"),
            F.sum(pnl).alias("total"),
            F.avg(pnl).alias("mean"),
            (100.0 * F.count_if(pnl > 0) / n).alias("win_rate"),
            F.avg(F.when(pnl > 0, pnl)).alias("avg_winner"),
            F.avg(F.when(pnl <= 0, pnl)).alias("avg_loser"),
            F.max(pnl).alias("best"),
            F.min(pnl).alias("worst"),
            profit_factor(pnl, sentinel).alias("profit_factor"),
            F.avg(pnl * pnl).alias("mean_square"),
        )
        .filter(F.col("n") >= min_trades)
    )


def reliability(mean: Column, mean_square: Column, n: Column) -> Column:
    """Percent confidence that the mean is above zero; 0 for fewer than three trades or no gain."""
    sigma = F.sqrt(F.greatest(mean_square - mean * mean, F.lit(1e-4)))
    return F.when((n < 3) | (mean <= 0), 0.0).otherwise(100 * normal_cdf(mean / (sigma / F.sqrt(n))))


def winners(stats: DataFrame, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """The first row of every cell; ties go to the first account by name."""
    w = Window.partitionBy(*(keys or CELL)).orderBy(*order, F.asc("account_name"))
    return stats.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def slot_matrix(trades: DataFrame, *, days: int = 30, min_trades: int = 3, min_win_rate: float = 0.0, filter_first: bool = False) -> DataFrame:
    """Best account of every cell by mean profit. The filters apply after ranking, so a weak winner empties its cell, unless
    ``filter_first``."""
    stats = slot_stats(fresh(trades, days), min_trades)
    good = (F.col("mean") > 0) & (F.col("win_rate") >= min_win_rate)
    order = [F.desc("mean"), F.desc("win_rate")]
    return winners(stats.filter(good), order) if filter_first else winners(stats, order).filter(good)


def monthly_persistence(trades: DataFrame) -> DataFrame:
    """Of every account and slot: active months, profitable ones, and their share in percent."""
    month = F.date_format("entry_time", "yyyy-MM")
    monthly = trades.groupBy("account_name", "slot", month.alias("month")).agg(F.sum("profit_loss").alias("pnl"), F.count("*").alias("n"))
    return monthly.groupBy("account_name", "slot").agg(
        F.count("*").alias("months"),
        F.count_if(F.col("pnl") > 0).alias("good_months"),
        (100.0 * F.count_if(F.col("pnl") > 0) / F.count("*")).alias("persistence"),
        F.sum("pnl").alias("total"),
        F.sum("n").alias("n"),
        profit_factor(F.col("pnl"), 99.0).alias("monthly_profit_factor"),
    )


def leaders(persistence: DataFrame) -> DataFrame:
    """Per slot the accounts that lead in persistence, profit or volume, with a tag for each."""
    rank = lambda c: F.row_number().over(Window.partitionBy("slot").orderBy(F.desc(c), F.asc("account_name"))) == 1
    tagged = persistence.withColumns({"a": rank("persistence"), "b": rank("total"), "c": rank("n")})
    tags = F.array_compact(F.array(F.when(F.col("a"), "persistence"), F.when(F.col("b"), "profit"), F.when(F.col("c"), "volume")))
    return tagged.withColumn("tags", F.array_join(tags, "+")).filter("tags <> ''").drop("a", "b", "c")


def rolling_vote(trades: DataFrame, weeks: tuple[int, ...] = (1, 2, 4), decay: float = 0.85, min_trades: int = 3) -> DataFrame:
    """Per cell, the account that most look-back windows choose by decayed mean profit, and how large that majority is."""
    aged = trades.crossJoin(F.broadcast(as_of(trades))).withColumn("ago", F.floor(F.datediff(F.to_date("now"), F.to_date("entry_time")) / 7)).filter(F.col("ago") < max(weeks))
    # Weeks are summed before windows multiply them.
    weekly = aged.groupBy("account_name", *CELL, "ago").agg(F.sum("profit_loss").alias("pnl"), F.count("*").alias("k"))
    wide = weekly.select("*", F.explode(F.array(*map(F.lit, weeks))).alias("w")).filter(F.col("ago") < F.col("w")).withColumn("weight", F.pow(F.lit(decay), F.col("ago")))
    score = wide.groupBy("w", "account_name", *CELL).agg((F.sum(F.col("pnl") * F.col("weight")) / F.sum(F.col("k") * F.col("weight"))).alias("score"), F.sum("k").alias("n")).filter(F.col("n") >= min_trades)
    picks = winners(score, [F.desc("score")], ["w", *CELL])
    votes = picks.groupBy(*CELL, "account_name").agg(F.count("*").alias("votes"))
    share = F.col("votes") / F.sum("votes").over(Window.partitionBy(*CELL))
    return winners(votes.withColumn("share", share), [F.desc("votes")]).withColumn("confidence", F.when(F.col("share") >= 0.75, "High").when(F.col("share") >= 0.5, "Medium").otherwise("Low"))


def slot_grid(stats: DataFrame) -> DataFrame:
    """All 48 slots for every account, with what it did there."""
    half_hours = stats.sparkSession.range(48).select(F.format_string("%02d:%02d", (F.col("id") / 2).cast("int"), (F.col("id") % 2 * 30).cast("int")).alias("slot"))
    grid = stats.select("account_name").distinct().crossJoin(F.broadcast(half_hours))
    return grid.join(stats, ["account_name", "slot"], "left")
