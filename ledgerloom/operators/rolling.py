"""Features of a series of trades: rolling and cumulative measures, bands, cyclic times, drops by bin, monitoring limits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .series import BY_TRADE


def _pnl() -> Column:
    return F.col("profit_loss")


def rolling(trades: DataFrame, width: int, *keys: str) -> DataFrame:
    """Mean, sigma (0 for one trade), sum, least, largest, win rate and sharpe of the last ``width`` trades, this one included."""
    w = Window.partitionBy(*keys).orderBy(*BY_TRADE).rowsBetween(1 - width, 0)
    sigma = F.coalesce(F.stddev_samp(_pnl()).over(w), F.lit(0.0))
    mean = F.avg(_pnl()).over(w)
    out = {"mean": mean, "sigma": sigma, "sum": F.sum(_pnl()).over(w), "least": F.min(_pnl()).over(w), "largest": F.max(_pnl()).over(w), "win_rate": F.avg((_pnl() > 0).cast("double")).over(w), "sharpe": F.coalesce(mean / F.nullif(sigma, F.lit(0.0)), F.lit(0.0))}
    return trades.withColumns({f"roll_{n}": c for n, c in out.items()})


def cumulative(trades: DataFrame, *keys: str) -> DataFrame:
    """Running profit, wins, win rate and drop from the running peak, by a scan over days."""
    sums = {"cum_pnl": _pnl(), "cum_wins": (_pnl() > 0).cast("long"), "nth": F.lit(1).cast("long")}
    run = scans.running(trades, list(keys), BY_TRADE, F.to_date("entry_time"), sums, {"_peak": "cum_pnl"})
    return run.withColumn("cum_rate", F.col("cum_wins") / F.col("nth")).withColumn("cum_drop", F.col("_peak") - F.col("cum_pnl")).drop("_peak")


def bands(trades: DataFrame, width: int, *keys: str) -> DataFrame:
    """Moving average, bands of two sigma, and relative strength of the last ``width`` profits; null until there are so many.

    Nothing is filled backwards, so no row knows a later one.
    """
    w = Window.partitionBy(*keys).orderBy(*BY_TRADE).rowsBetween(1 - width, 0)
    full = F.count("*").over(w) == width
    mean, sigma = F.avg(_pnl()).over(w), F.stddev_samp(_pnl()).over(w)
    gain, loss = (F.avg(F.greatest(s * _pnl(), F.lit(0.0))).over(w) for s in (1, -1))
    rsi = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    return trades.withColumns({"sma": F.when(full, mean), "upper": F.when(full, mean + 2 * sigma), "lower": F.when(full, mean - 2 * sigma), "rsi": F.when(full, rsi)})


def cyclic(trades: DataFrame) -> DataFrame:
    """Hour and weekday on circles, so that their ends meet."""
    turn = lambda c, n: 2 * math.pi * F.col(c) / n
    return trades.withColumns({"hour_sin": F.sin(turn("hour", 24)), "hour_cos": F.cos(turn("hour", 24)), "dow_sin": F.sin(turn("dow", 7)), "dow_cos": F.cos(turn("dow", 7))})


def bin_metrics(trades: DataFrame, keys: list[str], rate: float = 0.0) -> DataFrame:
    """By bin: sharpe, calmar and sortino of yearly scale, win rate, profit factor, and the worst drop from the peak.

    Here the peak begins at the first value, so a first loss is no drop; sortino takes the sample sigma of losses.
    """
    run = scans.running(trades, keys, BY_TRADE, F.to_date("entry_time"), {"_e": _pnl()}, {"_t": "_e"}).withColumn("_d", F.col("_t") - F.col("_e"))
    mean, sigma, loss = F.avg(_pnl()), F.stddev_samp(_pnl()), F.stddev_samp(F.when(_pnl() < 0, _pnl()))
    year = math.sqrt(252)
    return run.groupBy(*keys).agg(
        F.count("*").alias("n"),
        mean.alias("mean"),
        (F.count_if(_pnl() > 0) / F.count("*")).alias("win_rate"),
        (F.sum(F.when(_pnl() > 0, _pnl())) / F.nullif(F.abs(F.sum(F.when(_pnl() < 0, _pnl()))), F.lit(0.0))).alias("profit_factor"),
        ((252 * mean - rate) / F.nullif(sigma * year, F.lit(0.0))).alias("sharpe"),
        (252 * mean / F.nullif(F.max("_d"), F.lit(0.0))).alias("calmar"),
        ((252 * mean - rate) / F.nullif(loss * year, F.lit(0.0))).alias("sortino"),
        F.max("_d").alias("worst_drop"),
    )


def capital_curve(trades: DataFrame, capital: float, commission: float, *keys: str) -> DataFrame:
    """Equity after every trade from ``capital``, and the drop as a share of its peak, which begins at ``capital``."""
    e = scans.running(trades, list(keys), BY_TRADE, F.to_date("entry_time"), {"equity": _pnl() - commission}, {"_top": "equity"})
    peak = capital + F.greatest("_top", F.lit(0.0))
    return e.withColumn("drop_share", (peak - capital - F.col("equity")) / peak).withColumn("equity", capital + F.col("equity")).drop("_top")


def anomalies(snaps: DataFrame, *keys: str, width: int = 20, least: int = 10, z: float = 3.0, losses: int = 5) -> DataFrame:
    """Snapshots (start, n, total) far from the ``width`` before them: volume, loss streaks, worse results. At least ``least`` are needed."""
    w = Window.partitionBy(*keys).orderBy("start")
    before = w.rowsBetween(-width, -1)
    known = F.count("*").over(before)
    lost = F.sum((F.col("total") < 0).cast("int")).over(w.rowsBetween(1 - losses, 0))
    volume = (F.col("n") - F.avg("n").over(before)) / F.nullif(F.stddev_samp("n").over(before), F.lit(0.0))
    result = (F.col("total") - F.avg("total").over(before)) / F.nullif(F.stddev_samp("total").over(before), F.lit(0.0))
    rated = snaps.withColumns({"known": known, "volume_z": volume, "result_z": result, "losing": lost})
    kinds = F.array_compact(F.array(F.when(F.abs("volume_z") > z, F.lit("volume")), F.when(F.col("result_z") < -z, F.lit("degradation")), F.when(F.col("losing") >= losses, F.lit("loss_streak"))))
    return rated.filter(F.col("known") >= least).withColumn("anomaly", F.explode(kinds)).drop("known")


def degraded(trades: DataFrame, key: str, recent_days: int = 7) -> DataFrame:
    """Baseline against recent trades: Welch's t of means, z of win rates, ratio of variances."""
    now = trades.agg(F.max("entry_time").alias("now"))
    recent = F.col("entry_time") > F.col("now") - F.make_dt_interval(days=F.lit(recent_days))
    t = trades.crossJoin(F.broadcast(now)).withColumn("recent", recent)
    new, old = F.when(F.col("recent"), _pnl()), F.when(~F.col("recent"), _pnl())
    parts = lambda x, s: [F.count(x).alias(f"n_{s}"), F.avg(x).alias(f"mean_{s}"), F.var_samp(x).alias(f"var_{s}"), F.avg((x > 0).cast("double")).alias(f"rate_{s}")]
    g = t.groupBy(key).agg(*parts(old, "old"), *parts(new, "new")).filter("n_old >= 2 and n_new >= 2")
    both = (F.col("rate_old") * F.col("n_old") + F.col("rate_new") * F.col("n_new")) / (F.col("n_old") + F.col("n_new"))
    welch = (F.col("mean_new") - F.col("mean_old")) / F.nullif(F.sqrt(F.col("var_old") / F.col("n_old") + F.col("var_new") / F.col("n_new")), F.lit(0.0))
    rates = (F.col("rate_new") - F.col("rate_old")) / F.nullif(F.sqrt(both * (1 - both) * (1 / F.col("n_old") + 1 / F.col("n_new"))), F.lit(0.0))
    return g.select(key, "n_old", "n_new", welch.alias("t"), rates.alias("z_win_rate"), (F.col("var_new") / F.nullif(F.col("var_old"), F.lit(0.0))).alias("variance_ratio"))


def iqr_outliers(trades: DataFrame, *keys: str, factor: float = 1.5) -> DataFrame:
    """Trades outside the quartiles by ``factor`` times their distance. Quartiles are found by rank, no group is held in one place."""
    rank = trades.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("profit_loss", "trade_id")) - 1)
    n = trades.groupBy(*keys).agg(F.count("*").alias("_n"))
    at = lambda q: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * q).cast("int"), _pnl()))
    fences = rank.join(n, list(keys)).groupBy(*keys).agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    wide = factor * (F.col("q3") - F.col("q1"))
    return trades.join(fences, list(keys)).filter((_pnl() < F.col("q1") - wide) | (_pnl() > F.col("q3") + wide))


def runs_test(trades: DataFrame, key: str) -> DataFrame:
    """Runs of gaining and losing days by account against what chance gives: z of the number of runs."""
    day = trades.groupBy(key, F.to_date("entry_time").alias("date")).agg((F.sum(_pnl()) > 0).alias("up"))
    flip = (~F.col("up").eqNullSafe(F.lag("up").over(Window.partitionBy(key).orderBy("date")))).cast("int")
    g = day.withColumn("flip", flip).groupBy(key).agg(F.count_if("up").alias("ups"), F.count_if(~F.col("up")).alias("downs"), F.sum("flip").alias("runs"))
    n = F.col("ups") + F.col("downs")
    both = 2.0 * F.col("ups") * F.col("downs")
    return g.filter("ups > 0 and downs > 0").select(key, "ups", "downs", "runs", ((F.col("runs") - (both / n + 1)) / F.nullif(F.sqrt(both * (both - n) / (n * n * (n - 1))), F.lit(0.0))).alias("z"))
