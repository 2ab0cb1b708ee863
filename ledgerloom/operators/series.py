"""Ordered series: equity, drawdowns, rolling windows, streaks, regimes. Every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def _pnl() -> Column:
    return F.col("profit_loss")

BY_TRADE = ["entry_time", "trade_id"]


def _upto(*keys: str):
    return Window.partitionBy(*keys).orderBy(*BY_TRADE).rowsBetween(Window.unboundedPreceding, 0)


def _day(at: str = "entry_time") -> Column:
    return F.to_date(at)


def drawdown(trades: DataFrame, *keys: str, floor: bool = True) -> DataFrame:
    """Running equity, its peak (from zero if ``floor``) and the drop from it. A series is scanned by days."""
    run = scans.running(trades, list(keys), BY_TRADE, _day(), {"equity": _pnl()}, {"peak": "equity"})
    return run.withColumn("peak", F.greatest("peak", F.lit(0.0)) if floor else F.col("peak")).withColumn("drawdown", F.col("peak") - F.col("equity"))


def _exact_drawdown(trades: DataFrame, *keys: str) -> DataFrame:
    """:func:`drawdown` in decimals of six places, so that an equity that comes back to its peak is neither a new peak nor a drop.
    In doubles the order of the additions would decide."""
    run = scans.running(trades, list(keys), BY_TRADE, _day(), {"equity": _pnl().cast("decimal(20,6)")}, {"peak": "equity"})
    return run.withColumn("peak", F.greatest("peak", F.lit(0))).withColumn("drawdown", F.col("peak") - F.col("equity"))


def drawdown_periods(trades: DataFrame, *keys: str) -> DataFrame:
    """Islands between new peaks that hold a drop: start, trough depth, trades, and whether it ended."""
    d = _exact_drawdown(trades, *keys)
    before = Window.partitionBy(*keys).orderBy(*BY_TRADE)
    new_peak = F.when(F.col("peak") > F.coalesce(F.lag("peak").over(before), F.lit(0)), 1).otherwise(0)
    island = d.withColumn("np", new_peak).withColumn("island", F.sum("np").over(_upto(*keys)))
    last = F.max("island").over(Window.partitionBy(*keys))
    under = island.withColumn("open", F.col("island") == last).filter("drawdown > 0")
    return under.groupBy(*keys, "island").agg(F.min("entry_time").alias("start"), F.max("drawdown").cast("double").alias("depth"), F.count("*").alias("n"), (~F.bool_or("open")).alias("recovered"))


def drawdown_recoveries(trades: DataFrame, *keys: str) -> DataFrame:
    """:func:`drawdown_periods` with the time of the deepest point (the first of equals) and that of the new peak that ended it, if any."""
    d = _exact_drawdown(trades, *keys)
    before = Window.partitionBy(*keys).orderBy(*BY_TRADE)
    new_peak = F.when(F.col("peak") > F.coalesce(F.lag("peak").over(before), F.lit(0)), 1).otherwise(0)
    island = d.withColumn("np", new_peak).withColumn("island", F.sum("np").over(_upto(*keys)))
    under = F.col("drawdown") > 0
    deepest = F.min(F.when(under, F.struct((-F.col("drawdown")).alias("d"), "entry_time", "trade_id")))
    each = island.groupBy(*keys, "island").agg(F.min("entry_time").alias("began"), F.min(F.when(under, F.col("entry_time"))).alias("start"), F.max("drawdown").cast("double").alias("depth"), deepest["entry_time"].alias("trough"), F.count_if(under).alias("n"))
    return each.withColumn("recovery", F.lead("began").over(Window.partitionBy(*keys).orderBy("island"))).filter("n > 0").drop("began")


def sequence_features(trades: DataFrame, *keys: str) -> DataFrame:
    """Result of the next trade, trades left in the day, and whether the side is that of the trade before."""
    w = Window.partitionBy(*keys).orderBy(*BY_TRADE)
    # Counted from the day's last trade back: a frame that runs on to the end of the day is counted anew for every row.
    left = F.row_number().over(Window.partitionBy(*keys, F.to_date("entry_time")).orderBy(*[F.desc(c) for c in BY_TRADE])) - 1
    return trades.withColumns({"next": F.lead(_pnl()).over(w), "left_today": left.cast("long"), "same_side": F.col("side") == F.lag("side").over(w)})


def rolling_drops(trades: DataFrame, days: int, *keys: str, least: int = 2) -> DataFrame:
    """For every trade with ``least`` trades or more in the ``days`` up to its exit: their number and profit, sharpe (times the root
    of 252), and the deepest drop within them from a peak that begins at zero. Trades are taken by exit, then id; those with one
    exit time come in up to this one."""
    run = scans.rolling_stretch(trades, days, list(keys), F.col("exit_time"), "trade_id", _pnl())
    n, s, q = (F.col(f"stretch.{c}") for c in "nsq")
    sigma = F.sqrt(F.greatest((q - s * s / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))
    out = run.filter(n >= least).withColumns({"n_window": n, "pnl_window": s, "sharpe_window": s / n / F.when(sigma > 1e-9, sigma) * F.sqrt(F.lit(252.0)), "drop_window": F.col("stretch.drop")})
    return out.drop("stretch")


def rolling_days(trades: DataFrame, days: int, *keys: str) -> DataFrame:
    """Trades and profit of the ``days`` before and including each exit time, with all of that time."""
    run = rolling_drops(trades, days, *keys, least=1).drop("sharpe_window", "drop_window")
    same = Window.partitionBy(*keys, "exit_time").orderBy("trade_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return run.withColumns({"n_window": F.last("n_window").over(same), "pnl_window": F.last("pnl_window").over(same)})


def streaks(trades: DataFrame, *keys: str) -> DataFrame:
    """Runs of wins and losses: how many there are and the longest of each."""
    w = Window.partitionBy(*keys).orderBy(*BY_TRADE)
    win = _pnl() > 0
    flip = F.when(win.eqNullSafe(F.lag(win).over(w)), 0).otherwise(1)
    runs = trades.withColumn("win", win).withColumn("f", flip).withColumn("run", F.sum("f").over(_upto(*keys))).groupBy(*keys, "run", "win").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.max(F.when(F.col("win"), F.col("n"))).alias("longest_win"), F.max(F.when(~F.col("win"), F.col("n"))).alias("longest_loss"), F.count("*").alias("runs"))


def features(trades: DataFrame, *keys: str) -> DataFrame:
    """Lagged profit, change and the change before it, number in the day, five-trade mean before this trade.

    All look back over five trades at most. So windows run within days, and each day begins with the last five trades before it.
    """
    known = scans.led_in(trades, list(keys), BY_TRADE, _day(), ["profit_loss"], 5)
    w = Window.partitionBy("_at").orderBy(F.desc("_lead"), *BY_TRADE)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = known.withColumns({"prev": F.lag(_pnl()).over(w), "before": F.lag(_pnl(), 2).over(w), "nth_today": F.sum(F.when(F.col("_lead"), 0).otherwise(1)).over(upto).cast("int"), "mean5": F.avg(_pnl()).over(w.rowsBetween(-5, -1))})
    return run.filter("not _lead").withColumns({"change": _pnl() - F.col("prev"), "prev_change": F.col("prev") - F.col("before")}).drop("_at", "_lead", "before")


def regimes(market: DataFrame, low: float = 15.0, high: float = 25.0) -> DataFrame:
    """Regime of every day and since when it lasts. A daily index has one row a day, so one partition holds it."""
    label = F.when(F.col("close") < low, "Low").when(F.col("close") <= high, "Medium").otherwise("High")
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    marked = market.withColumn("regime", label).withColumn("change", F.when(F.col("regime").eqNullSafe(F.lag("regime").over(w)), 0).otherwise(1))
    island = marked.withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.withColumn("since", F.min("date").over(Window.partitionBy("island"))).withColumn("days", F.datediff("date", "since")).select("date", "close", "regime", "since", "days")


def regime_transitions(market: DataFrame) -> DataFrame:
    """Share of every pair of consecutive regimes among all pairs."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    pairs = regimes(market).withColumn("to_regime", F.lead("regime").over(w)).filter("to_regime is not null")
    n = pairs.groupBy("regime", "to_regime").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def rolling_correlation(pairs: DataFrame, width: int, *keys: str) -> DataFrame:
    """Correlation and slope of y on x over the ``width`` rows before each."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-width, -1)
    enough = F.count("*").over(w) >= width
    return pairs.withColumns({"correlation": F.when(enough, F.corr("x", "y").over(w)), "slope": F.when(enough, F.covar_pop("x", "y").over(w) / F.nullif(F.var_pop("x").over(w), F.lit(0.0)))})


def adjusted_p(tests: DataFrame, family: list[str]) -> DataFrame:
    """False-discovery-rate adjusted p values per family; nulls pass through."""
    m = F.count("p").over(Window.partitionBy(*family))
    up = Window.partitionBy(*family).orderBy(F.col("p").asc_nulls_last(), "id")
    ranked = tests.withColumn("k", F.row_number().over(up)).withColumn("m", m)
    down = Window.partitionBy(*family).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q", F.when(F.col("p").isNotNull(), F.least(F.min(F.col("p") * F.col("m") / F.col("k")).over(down), F.lit(1.0)))).drop("k", "m")
