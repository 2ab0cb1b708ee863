"""Recommended time bins of every account: scored, with tiers of confidence and risk, gated by what came after training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import binomial_p_value

from .rolling import bin_metrics
from .series import adjusted_p


def bins(train: DataFrame, test: DataFrame, keys: list[str], *, min_trades: int = 30, min_win_rate: float = 0.5, min_mean: float = 0.0, significant: bool = True, rate: float = 0.05, least_drop: float = 500.0) -> DataFrame:
    """One row for every bin of an account that meets the criteria in training, best score first within account and status.

    ``score`` is 0.4 * mean + 30 * win rate + 2 * sharpe + 0.5 * profit factor. A bin is significant if the exact p of its win
    rate, adjusted among the account's bins with enough trades, is at most ``rate``; then ``confidence`` is High from 100 trades on and
    Medium from 50 on, else Low. ``risk`` is High if the worst drop is over ten mean profits, Medium over five. ``status`` is validated
    if the later trades have a sharpe above zero and a worst drop under three mean profits or ``least_drop``, failed if not, and pending
    if there are none. Ranks count among equals of account and status; ties go by the bin.
    """
    all_keys = ["account_name", *keys]
    m = bin_metrics(train, all_keys)
    wins = train.groupBy(*all_keys).agg(F.count_if(F.col("profit_loss") > 0).alias("wins"))
    tested = m.join(wins, all_keys).filter(F.col("n") >= min_trades).withColumn("p", binomial_p_value(F.col("wins"), F.col("n"))).withColumn("id", F.struct(*keys))
    q = adjusted_p(tested, ["account_name"]).withColumn("significant", F.col("q") <= rate)
    good = (F.col("win_rate") >= min_win_rate) & (F.col("mean") >= min_mean)
    met = q.filter(good & F.col("significant") if significant else good)
    score = 0.4 * F.col("mean") + 30.0 * F.col("win_rate") + 2.0 * F.coalesce("sharpe", F.lit(0.0)) + 0.5 * F.coalesce("profit_factor", F.lit(0.0))
    confidence = F.when(F.col("significant") & (F.col("n") >= 100), "High").when(F.col("significant") & (F.col("n") >= 50), "Medium").otherwise("Low")
    drop: Column = F.abs("worst_drop")
    risk = F.when(drop > 10 * F.col("mean"), "High").when(drop > 5 * F.col("mean"), "Medium").otherwise("Low")
    later = bin_metrics(test, all_keys).select(*all_keys, F.lit(True).alias("seen"), F.col("sharpe").alias("oos_sharpe"), F.col("worst_drop").alias("oos_drop"))
    passes = F.coalesce((F.col("oos_sharpe") > 0) & (F.col("oos_drop") < F.greatest(3 * F.abs("mean"), F.lit(least_drop))), F.lit(False))
    rated = met.join(later, all_keys, "left").withColumns({"score": score, "confidence": confidence, "risk": risk, "status": F.when(F.col("seen").isNull(), "pending").when(passes, "validated").otherwise("failed")})
    place = F.row_number().over(Window.partitionBy("account_name", "status").orderBy(F.desc(F.round("score", 6)), *keys))
    return rated.withColumn("place", place).select(*all_keys, "n", "mean", "win_rate", "q", "score", "confidence", "risk", "status", "place")


def summary(train: DataFrame, recommended: DataFrame, keys: list[str]) -> DataFrame:
    """By account: bins traded in training, bins that met the criteria, and how many of them are validated, pending and failed."""
    seen = train.select("account_name", *keys).distinct().groupBy("account_name").agg(F.count("*").alias("bins"))
    counted = recommended.groupBy("account_name").agg(F.count("*").alias("met"), *[F.count_if(F.col("status") == s).alias(s) for s in ("validated", "pending", "failed")])
    return seen.join(counted, "account_name", "left").select("account_name", "bins", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("met", "validated", "pending", "failed")])
