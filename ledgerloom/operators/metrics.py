"""Performance measures of accounts, over trades and over days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slots import profit_factor

def _pnl() -> Column:
    return F.col("profit_loss")



def account_summary(trades: DataFrame) -> DataFrame:
    return trades.groupBy("account_name").agg(
        F.count("*").alias("n"),
        F.count_if(_pnl() > 0).alias("wins"),
        F.count_if(_pnl() <= 0).alias("losses"),
        F.sum(_pnl()).alias("total"),
        F.avg(F.when(_pnl() > 0, _pnl())).alias("avg_win"),
        F.avg(F.when(_pnl() <= 0, _pnl())).alias("avg_loss"),
        F.max(_pnl()).alias("best"),
        F.min(_pnl()).alias("worst"),
        F.stddev_pop(_pnl()).alias("volatility"),
        F.avg((F.unix_timestamp(F.col("exit_time").cast("timestamp")) - F.unix_timestamp(F.col("entry_time").cast("timestamp"))) / 60).alias("avg_minutes"),
        F.min("entry_time").alias("first_entry"),
        F.max("entry_time").alias("last_entry"),
    )


def full_metrics(trades: DataFrame) -> DataFrame:
    """Win rate, profit factor, sharpe (not annualised), win/loss ratio, expectancy and a flag for a high win rate with small wins."""
    wr = F.count_if(_pnl() > 0) / F.count("*")
    win, loss = F.avg(F.when(_pnl() > 0, _pnl())), F.abs(F.avg(F.when(_pnl() <= 0, _pnl())))
    ratio = win / F.nullif(loss, F.lit(0.0))
    return trades.groupBy("account_name", "symbol").agg(
        F.count("*").alias("n"),
        wr.alias("win_rate"),
        profit_factor(_pnl(), 999.0).alias("profit_factor"),
        (F.avg(_pnl()) / F.nullif(F.stddev_samp(_pnl()), F.lit(0.0))).alias("sharpe"),
        ratio.alias("win_loss_ratio"),
        (wr * win - (1 - wr) * loss).alias("expectancy"),
        F.coalesce((wr > 0.55) & (ratio < 1), F.lit(False)).alias("risk_flag"),
    )


def daily_ratios(trades: DataFrame) -> DataFrame:
    """Sharpe and sortino over daily sums, population sigma, times the root of 252; 99.9 where no day lost."""
    day = trades.groupBy("account_name", F.to_date("entry_time").alias("day")).agg(F.sum(_pnl()).alias("d"))
    down = F.sqrt(F.sum(F.when(F.col("d") < 0, F.col("d") * F.col("d")).otherwise(0.0)) / F.count("*"))
    return day.groupBy("account_name").agg(
        F.count("*").alias("days"),
        (F.avg("d") / F.nullif(F.stddev_pop("d"), F.lit(0.0)) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.when(down > 0, F.avg("d") / down * F.sqrt(F.lit(252.0))).otherwise(99.9).alias("sortino"),
    )


def sortino_ranking(trades: DataFrame, top: int = 10) -> DataFrame:
    """Accounts and symbols by annualised sortino; downside sigma is that of the losses."""
    loss = F.when(_pnl() < 0, _pnl())
    span = F.greatest(F.datediff(F.max("entry_time"), F.min("entry_time")), F.lit(1))
    base = trades.groupBy("account_name", "symbol").agg(F.count("*").alias("n"), F.avg(_pnl()).alias("mean"), F.count(loss).alias("losses"), F.stddev_pop(loss).alias("sigma"), span.alias("span"))
    rated = base.filter("losses > 1 and sigma > 0").withColumn("sortino", F.col("mean") / F.col("sigma") * F.sqrt(F.col("n") / F.col("span") * 252)).withColumn("per_week", F.col("n") / F.col("span") * 5)
    return rated.orderBy(F.desc("sortino"), F.desc("per_week"), "account_name", "symbol").limit(top).select("account_name", "symbol", "n", "sortino", "per_week")


def _ranked(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Trades with their place by profit within their group (``_r``, from 0) and the group's size (``_n``).

    The window spills to disk if a group is large; sizes are counted before, on the map side.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("profit_loss")) - 1
    return trades.select(*keys, "profit_loss", place.alias("_r")).join(trades.groupBy(*keys).agg(F.count("*").alias("_n")), keys)


def probability_matrix(trades: DataFrame, keys: list[str], min_trades: int = 5) -> DataFrame:
    """Distribution of a cell's profits: moments, chances, tail mean, quartiles by index, and mean times chance of gain.

    Places are found by a window that spills, so a cell may hold any number of trades.
    """
    n = F.count("*")
    at = lambda q: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * q), _pnl()))
    tail = F.greatest(F.floor(F.col("_n") * 0.05), F.lit(1))
    cells = _ranked(trades, keys).groupBy(*keys).agg(
        n.alias("n"),
        F.avg(_pnl()).alias("mean"),
        F.var_pop(_pnl()).alias("variance"),
        F.skewness(_pnl()).alias("skew"),
        F.kurtosis(_pnl()).alias("kurtosis"),
        *[(F.count_if(_pnl() > limit) / n).alias(name) for limit, name in ((0, "p_gain"), (50, "p_50"), (100, "p_100"))],
        F.avg(F.when(F.col("_r") < tail, _pnl())).alias("cvar"),
        at(0.25).alias("q25"),
        at(0.75).alias("q75"),
        (F.avg(_pnl()) * F.count_if(_pnl() > 0) / n).alias("cwev"),
    )
    return cells.filter(F.col("n") >= min_trades)


def likeliest(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Of every cell the account with the largest ``cwev``; ties go to the first by name."""
    best = Window.partitionBy(*keys).orderBy(F.desc(F.round("cwev", 6)), "account_name")
    return cells.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def risk(trades: DataFrame, level: float = 0.95) -> DataFrame:
    """Value at risk (the profit at index floor((1 - level) * n) of the sorted ones), expected shortfall (mean of those up to
    it), kelly share clipped to a quarter, chance of loss, sortino (losses' root mean square, yearly scale)."""
    keys = ["account_name"]
    ranked = _ranked(trades, keys)
    var = ranked.filter(F.col("_r") == F.floor((1 - level) * F.col("_n") + 1e-9)).select(*keys, _pnl().alias("var"))
    joined = trades.join(var, keys)
    p, win, loss = F.count_if(_pnl() > 0) / F.count("*"), F.avg(F.when(_pnl() > 0, _pnl())), F.abs(F.avg(F.when(_pnl() <= 0, _pnl())))
    kelly = p - (1 - p) / (win / F.nullif(loss, F.lit(0.0)))
    span = F.greatest(F.datediff(F.max("entry_time"), F.min("entry_time")), F.lit(1))
    down = F.sqrt(F.sum(F.when(_pnl() < 0, _pnl() * _pnl()).otherwise(0.0)) / F.count("*"))
    return joined.groupBy(*keys).agg(
        F.first("var").alias("var"),
        F.avg(F.when(_pnl() <= F.col("var"), _pnl())).alias("shortfall"),
        F.greatest(F.least(kelly, F.lit(0.25)), F.lit(-0.25)).alias("kelly"),
        (F.count_if(_pnl() < 0) / F.count("*")).alias("p_loss"),
        (F.avg(_pnl()) / F.nullif(down, F.lit(0.0)) * F.sqrt(F.count("*") / span * 252)).alias("sortino"),
    )


def outliers(trades: DataFrame, z_win: float = 2.0, z_loss: float = 3.0) -> DataFrame:
    """Trades far from the mean of their account's winners or losers, of accounts with enough of both."""
    stats = (
        trades.groupBy("account_name")
        .agg(
            F.count("*").alias("n"),
            F.count_if(_pnl() > 0).alias("nw"),
            F.count_if(_pnl() < 0).alias("nl"),
            F.avg(F.when(_pnl() > 0, _pnl())).alias("mw"),
            F.stddev_pop(F.when(_pnl() > 0, _pnl())).alias("sw"),
            F.avg(F.when(_pnl() < 0, _pnl())).alias("ml"),
            F.stddev_pop(F.when(_pnl() < 0, _pnl())).alias("sl"),
        )
        .filter("n >= 10 and nw >= 5 and nl >= 5")
    )
    z = F.when(_pnl() > 0, (_pnl() - F.col("mw")) / F.nullif(F.col("sw"), F.lit(0.0))).when(_pnl() < 0, (_pnl() - F.col("ml")) / F.nullif(F.col("sl"), F.lit(0.0)))
    rated = trades.join(stats, "account_name").withColumn("z", z)
    return rated.filter(((_pnl() > 0) & (F.col("z") > z_win)) | ((_pnl() < 0) & (F.abs("z") > z_loss)))


def monthly_pivot(trades: DataFrame) -> DataFrame:
    """Year by month of exit, as twelve columns."""
    m = F.month("exit_time")
    return trades.groupBy("account_name", F.year("exit_time").alias("year")).agg(*[F.sum(F.when(m == i, _pnl()).otherwise(0.0)).alias(f"m{i:02d}") for i in range(1, 13)])


def hour_or_weekday(trades: DataFrame) -> DataFrame:
    """Aggregates by hour and by weekday in one pass: grouping sets."""
    return trades.groupingSets([["account_name", "hour"], ["account_name", "dow"]], "account_name", "hour", "dow").agg(F.count("*").alias("n"), F.sum(_pnl()).alias("total"), F.avg(_pnl()).alias("mean"))


def cube(trades: DataFrame, *keys: str) -> DataFrame:
    return trades.cube(*keys).agg(F.count("*").alias("n"), F.sum(_pnl()).alias("total"), F.grouping_id().alias("level"))


def quality_scores(trades: DataFrame) -> DataFrame:
    """Completeness, accuracy, consistency and uniqueness in percent, and their weighted sum."""
    n = F.count("*")
    share = lambda cond: 100.0 * F.count_if(cond) / n
    scored = trades.groupBy("account_name").agg(
        n.alias("n"),
        share(F.col("entry_time").isNotNull() & F.col("exit_time").isNotNull() & _pnl().isNotNull()).alias("completeness"),
        share((F.abs(_pnl()) <= 10000) & (F.col("quantity") > 0)).alias("accuracy"),
        share(F.col("exit_time") >= F.col("entry_time")).alias("consistency"),
        (100.0 * F.count_distinct("symbol", "entry_time", "exit_time", "profit_loss") / n).alias("uniqueness"),
    )
    return scored.withColumn("score", 0.3 * F.col("completeness") + 0.3 * F.col("accuracy") + 0.2 * F.col("consistency") + 0.2 * F.col("uniqueness"))


def duplicates(trades: DataFrame, keys: list[str]) -> DataFrame:
    return trades.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1").withColumn("extra", F.col("copies") - 1)


def concentration(trades: DataFrame) -> DataFrame:
    """Each symbol's share of an account's absolute profit, and the sum of squared shares."""
    base = trades.groupBy("account_name", "symbol").agg(F.abs(F.sum(_pnl())).alias("size"))
    share = F.col("size") / F.nullif(F.sum("size").over(Window.partitionBy("account_name")), F.lit(0.0))
    return base.withColumn("share", share).withColumn("hhi", F.sum(F.col("share") * F.col("share")).over(Window.partitionBy("account_name"))).select("account_name", "symbol", "share", "hhi")


def calmar(trades: DataFrame, *keys: str) -> DataFrame:
    """By key: mean profit, the deepest drop of the running profit from its peak (from zero), and the ratio of both; null without a drop.

    Drops come from a scan over days, so a key is many tasks."""
    from .series import drawdown

    d = drawdown(trades, *keys).groupBy(*keys).agg(F.avg("profit_loss").alias("mean"), F.max("drawdown").alias("deepest"))
    return d.withColumn("calmar", F.col("mean") / F.nullif("deepest", F.lit(0.0)))


def weighted_quality(trades: DataFrame, days: int = 730) -> DataFrame:
    """:func:`quality_scores` with timeliness, the share of trades entered in the ``days`` before the latest entry of all, and the
    overall score by weights of 0.25, 0.30, 0.20, 0.15 and 0.10."""
    latest = trades.agg(F.max("entry_time").alias("latest"))
    recent = F.col("entry_time") >= F.col("latest") - F.make_dt_interval(days=F.lit(days))
    timely = trades.select("account_name", "entry_time").crossJoin(F.broadcast(latest)).groupBy("account_name").agg((100.0 * F.count_if(recent) / F.count("*")).alias("timeliness"))
    weights = {"completeness": 0.25, "accuracy": 0.3, "consistency": 0.2, "timeliness": 0.15, "uniqueness": 0.1}
    overall = sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return quality_scores(trades).drop("score").join(timely, "account_name").withColumn("score", overall)
