"""Walk-forward with votes of several training windows, a bonus by regime, and stickiness to the pick of the fold before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.lineage import cut
from ledgerloom.functions.stats import binomial_p_value

from .series import adjusted_p
from .validation import _within, folds


def window_votes(partial: DataFrame, f: DataFrame, keys: list[str], regime: DataFrame | None, *, min_trades: int, min_mean: float, min_win_rate: float, least_days: int = 14) -> DataFrame:
    """By fold and cell: the account with most votes, and ``votes``.

    The whole training window, its later half and its last third each vote for the account of the best score, the later two with
    0.7; windows of under ``least_days`` days do not vote. The score is 0.6 * min(2, mean / 25) + 0.4 * min(2, 10 * mean / sigma
    / 4), a tenth of it where mean or win rate miss their limits. A regime (columns fold, regime) adds 0.1: High for means over
    30, Low for win rates over 70. Ties go to the first account by name.
    """
    total = F.datediff("train_hi", "train_lo")
    spans = f.select("fold", "train_hi", total.alias("total"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("part")).withColumn("days", F.floor(F.col("total") / (F.col("part") + 1)).cast("int"))
    spans = spans.filter(F.col("days") >= least_days).withColumn("lo", F.date_sub("train_hi", "days"))
    # The later windows lie in the first, so its days are dealt out once and each part sums those that are its own.
    laid = partial.join(spans.filter("part = 0").select("fold", F.explode(F.sequence("lo", F.date_sub("train_hi", 1))).alias("day")), "day")
    sums = laid.join(F.broadcast(spans), "fold").filter(F.col("day") >= F.col("lo")).groupBy("fold", "part", "days", "total", "account_name", *keys).agg(*[F.sum(c).alias(c) for c in ("pnl", "square", "n", "wins")])
    least = F.greatest(F.lit(3), F.floor(F.lit(min_trades) * F.col("days") / F.col("total")))
    mean, rate = F.col("pnl") / F.col("n"), 100.0 * F.col("wins") / F.col("n")
    rated = sums.filter(F.col("n") >= least).withColumns({"mean": mean, "rate": rate})
    sigma = F.sqrt(F.greatest(F.lit(1.0), F.col("square") / F.col("n") - F.col("mean") * F.col("mean")))
    score = 0.6 * F.least(F.lit(2.0), F.col("mean") / 25) + 0.4 * F.least(F.lit(2.0), 10 * F.col("mean") / sigma / 4)
    score = F.when((F.col("mean") < min_mean) | (F.col("rate") < min_win_rate), score * 0.1).otherwise(score)
    rated = rated.withColumn("score", F.round(score, 9))
    first = F.row_number().over(Window.partitionBy("fold", "part", *keys).orderBy(F.desc("score"), "account_name"))
    best = rated.withColumn("r", first).filter("r = 1")
    best = best.join(F.broadcast(regime), "fold", "left") if regime is not None else best.withColumn("regime", F.lit(None).cast("string"))
    bonus = F.when(((F.col("regime") == "High") & (F.col("mean") > 30)) | ((F.col("regime") == "Low") & (F.col("rate") > 70)), 0.1).otherwise(0.0)
    votes = best.groupBy("fold", *keys, "account_name").agg(F.round(F.sum(F.col("score") * F.when(F.col("part") == 0, 1.0).otherwise(0.7) + bonus), 8).alias("votes"))
    top = F.row_number().over(Window.partitionBy("fold", *keys).orderBy(F.desc("votes"), "account_name"))
    return votes.withColumn("r", top).filter("r = 1").drop("r")


def sticky_picks(votes: DataFrame, keys: list[str], *, sticky: float = 0.3, threshold: float = 0.8) -> DataFrame:
    """Which votes become picks: those over the threshold, and those over it with the bonus that the pick of the same account in the
    fold before gives.

    Whether a weak vote is picked hangs on the fold before, and that one's on its own, back to a strong vote. So a cell's folds
    are cut into runs: a strong vote begins one, and a vote that does not follow the same account's in the fold before begins
    one, too. A weak vote is picked if its run begins with a strong one. One window a cell, whatever the number of folds.
    """
    order = Window.partitionBy(*keys).orderBy("fold")
    strong, weak = F.col("votes") > threshold, F.col("votes") + sticky > threshold
    before = F.lag(F.struct("fold", "account_name", weak.alias("may"))).over(order)
    follows = F.coalesce((before["fold"] == F.col("fold") - 1) & (before["account_name"] == F.col("account_name")) & before["may"], F.lit(False))
    cut = votes.withColumn("begins", strong | ~follows)
    run = cut.withColumn("run", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.first(strong).over(Window.partitionBy(*keys, "run").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0))
    picked = run.withColumn("held", held).filter(strong | (weak & F.col("held")))
    return picked.select("fold", *keys, "account_name", "votes")


def fold_regimes(f: DataFrame, market: DataFrame, low: float = 15.0, high: float = 25.0, back: int = 30) -> DataFrame:
    """The regime of the last close in the ``back`` days before each fold's training ends; none is Medium."""
    days = f.select("fold", F.explode(F.sequence(F.date_sub("train_hi", back), F.date_sub("train_hi", 1))).alias("date"))
    close = days.join(market, "date").groupBy("fold").agg(F.max_by("close", "date").alias("close"))
    label: Column = F.when(F.col("close") < low, "Low").when(F.col("close") > high, "High").otherwise("Medium")
    return f.select("fold").join(close, "fold", "left").select("fold", label.alias("regime"))


def sticky_walk_forward(trades: DataFrame, keys: list[str], market: DataFrame | None = None, *, train_days: int = 364, test_days: int = 90, min_trades: int = 3, min_mean: float = 0.0, min_win_rate: float = 0.0, sticky: float = 0.3, threshold: float = 0.8, anchored: bool = False) -> DataFrame:
    """By fold: picked cells, and what following them in the test window gave.

    All folds are one plan over daily sums of the trades, which are read once. Sharpe takes the sample sigma of trades and the
    number of trades a year at the fold's rate.
    """
    p = F.col("profit_loss")
    partial = cut(trades.groupBy("account_name", *keys, F.to_date("entry_time").alias("day")).agg(F.sum(p).alias("pnl"), F.sum(p * p).alias("square"), F.count("*").alias("n"), F.count_if(p > 0).alias("wins")))
    f = folds(partial, train_days, test_days, anchored=anchored, at="day")
    regime = fold_regimes(f, market) if market is not None else None
    votes = window_votes(partial, f, keys, regime, min_trades=min_trades, min_mean=min_mean, min_win_rate=min_win_rate)
    picks = sticky_picks(votes, keys, sticky=sticky, threshold=threshold)
    tested = _within(partial, f, "test_lo", "test_hi").join(picks, ["fold", "account_name", *keys])
    s = tested.groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("pnl", "square", "n", "wins")])
    cells = picks.groupBy("fold").agg(F.count("*").alias("cells"))
    sigma = F.sqrt(F.greatest((F.col("square") - F.col("pnl") * F.col("pnl") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)))
    sharpe = F.col("pnl") / F.col("n") / F.nullif(sigma, F.lit(0.0)) * F.sqrt(F.col("n") / F.lit(test_days) * 252)
    return cells.join(s, "fold", "left").select("fold", "cells", F.coalesce("n", F.lit(0)).alias("n"), F.col("pnl").alias("total"), (F.col("wins") / F.col("n")).alias("win_rate"), sharpe.alias("sharpe"))


def significant_walk_forward(trades: DataFrame, keys: list[str], *, train_days: int = 252, test_days: int = 63, min_trades: int = 30, rate: float = 0.05) -> DataFrame:
    """By fold: how many cells of accounts are significant in training (exact one-sided p of the win rate, adjusted within fold and
    account, half or more wins, mean above zero), and what they gave in the test window; zeros where none is.

    All folds are one plan over daily sums, which are stored, and the p values are of aggregated rows.
    """
    p = F.col("profit_loss")
    partial = cut(trades.groupBy("account_name", *keys, F.to_date("entry_time").alias("day")).agg(F.sum(p).alias("pnl"), F.count("*").alias("n"), F.count_if(p > 0).alias("wins")))
    f = folds(partial, train_days, test_days, at="day")
    trained = _within(partial, f, "train_lo", "train_hi").groupBy("fold", "account_name", *keys).agg(*[F.sum(c).alias(c) for c in ("pnl", "n", "wins")]).filter(F.col("n") >= min_trades)
    tested = trained.withColumn("p", binomial_p_value(F.col("wins"), F.col("n"))).withColumn("id", F.struct(*keys))
    q = adjusted_p(tested, ["fold", "account_name"])
    picks = q.filter((F.col("q") <= rate) & (2 * F.col("wins") >= F.col("n")) & (F.col("pnl") > 0)).select("fold", "account_name", *keys)
    later = _within(partial, f, "test_lo", "test_hi").join(picks, ["fold", "account_name", *keys]).groupBy("fold").agg(F.sum("n").alias("n"), F.sum("pnl").alias("total"), F.sum("wins").alias("wins"))
    cells = trained.groupBy("fold").agg(F.count("*").alias("tested")).join(picks.groupBy("fold").agg(F.count("*").alias("cells")), "fold", "left")
    out = f.select("fold").join(cells, "fold", "left").join(later, "fold", "left")
    return out.select("fold", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tested", "cells", "n")], F.coalesce("total", F.lit(0.0)).alias("total"), (F.col("wins") / F.col("n")).alias("win_rate"))
