"""Reports and checks over trades: buckets, attribution, alerts, consensus of windows, set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slots import CELL, as_of, slot_stats, winners


def _pnl() -> Column:
    return F.col("profit_loss")


def minutes(entry: str = "entry_time", exit_: str = "exit_time") -> Column:
    return (F.unix_timestamp(F.col(exit_).cast("timestamp")) - F.unix_timestamp(F.col(entry).cast("timestamp"))) / 60


def duration_buckets(trades: DataFrame, edges: tuple[int, ...] = (15, 30, 60)) -> DataFrame:
    """Trades, profit and win rate by side and length."""
    m = minutes()
    bucket = F.when(m < edges[0], f"under {edges[0]}")
    for lo, hi in zip(edges, edges[1:], strict=False):
        bucket = bucket.when(m < hi, f"{lo} to {hi}")
    bucket = bucket.otherwise(f"{edges[-1]} and over")
    return trades.groupBy("side", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(_pnl()).alias("total"), (F.count_if(_pnl() > 0) / F.count("*")).alias("win_rate"))


def reconciliation(trades: DataFrame, account: str, symbol_prefix: str) -> DataFrame:
    """Trades, lots and profit a day of one account (any case) and all symbols of a prefix."""
    own = trades.filter((F.upper("account_name") == account.upper()) & F.startswith(F.col("symbol"), F.lit(symbol_prefix)))
    return own.groupBy(F.to_date("entry_time").alias("date")).agg(F.count("*").alias("n"), F.sum("quantity").alias("lots"), F.sum(_pnl()).alias("total"))


def favourites(trades: DataFrame) -> DataFrame:
    """Best weekday and best hour of every account by profit: two aggregates, each reduced by max_by."""
    best = lambda c: trades.groupBy("account_name", c).agg(F.sum(_pnl()).alias("t")).groupBy("account_name").agg(F.max_by(c, F.struct(F.round("t", 6), -F.col(c))).alias(f"best_{c}"))
    return best("dow").join(best("hour"), "account_name")


def attribution(trades: DataFrame, key: str) -> DataFrame:
    """Share of every value of a key in its account's profit and trades."""
    w = Window.partitionBy("account_name")
    g = trades.groupBy("account_name", key).agg(F.sum(_pnl()).alias("total"), F.count("*").alias("n"))
    return g.withColumns({"pnl_share": F.col("total") / F.nullif(F.sum("total").over(w), F.lit(0.0)), "n_share": F.col("n") / F.sum("n").over(w)})


def account_alerts(trades: DataFrame, large: float = 300.0) -> DataFrame:
    """One row per account and alert, with how many trades raise it."""
    g = trades.groupBy("account_name").agg(
        F.count_if(F.col("exit_time") < F.col("entry_time")).alias("negative_duration"),
        F.count_if(F.to_date("entry_time") < F.to_date("exit_time")).alias("overnight"),
        F.count_if(F.abs(_pnl()) > large).alias("large_result"),
        F.greatest(F.count_distinct("symbol") - 1, F.lit(0)).alias("several_symbols"),
    )
    return g.unpivot("account_name", ["negative_duration", "overnight", "large_result", "several_symbols"], "alert", "n").filter("n > 0")


def consensus(trades: DataFrame, windows: dict[int, float], min_trades: int = 3) -> DataFrame:
    """Best account of a cell over several look-back windows: every window's winner votes with its score and weight."""
    spans = sorted(windows)
    at = trades.crossJoin(F.broadcast(as_of(trades)))
    inside = lambda w: F.col("entry_time") >= F.col("now") - F.make_dt_interval(days=F.lit(w))
    # The shortest window that holds a trade; sums of these parts make every window, so trades are not multiplied.
    part = F.coalesce(*[F.when(inside(w), F.lit(w)) for w in spans])
    sums = at.withColumn("part", part).filter("part is not null").groupBy("part", "account_name", *CELL).agg(F.count("*").alias("k"), F.sum(_pnl()).alias("s"), F.sum(_pnl() * _pnl()).alias("ss"))
    wide = sums.withColumn("w", F.explode(F.filter(F.array(*map(F.lit, spans)), lambda w: w >= F.col("part"))))
    g = wide.groupBy("w", "account_name", *CELL).agg(F.sum("k").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).filter(F.col("n") >= min_trades).withColumn("mean", F.col("s") / F.col("n"))
    g = g.withColumn("sd", F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("ss") - F.col("s") * F.col("mean"), F.lit(0.0)) / (F.col("n") - 1))))
    sharpe = F.col("mean") / (F.greatest(F.coalesce("sd", F.lit(1.0)), F.lit(1.0)) / 10)
    score = 0.6 * F.least(F.lit(2.0), F.col("mean") / 25) + 0.4 * F.least(F.lit(2.0), sharpe / 4)
    picks = winners(g.withColumn("score", F.round(score, 9)), [F.desc("score")], ["w", *CELL]).filter("score > 0")
    weight = F.coalesce(*[F.when(F.col("w") == k, F.lit(x)) for k, x in windows.items()])
    votes = picks.groupBy(*CELL, "account_name").agg(F.round(F.sum(F.col("score") * weight), 9).alias("conviction"))
    best = winners(votes, [F.desc("conviction")]).filter("conviction > 0.5")
    return best.withColumn("confidence", F.least(F.col("conviction") / 1.5, F.lit(1.0)))


def best_bins(trades: DataFrame, capital: float, top: int = 5) -> DataFrame:
    """Cells a small account can bear, ranked by a composite of min-max normalised measures over all such cells."""
    s = slot_stats(trades, 4, keys=["symbol", "slot"]).filter("mean > 0 and profit_factor >= 1.1").filter(F.coalesce(F.abs("avg_loser"), F.lit(0.0)) <= 0.25 * capital)
    span = s.agg(*[f(c).alias(f"{n}_{c}") for c in ("mean", "win_rate", "profit_factor") for n, f in (("lo", F.min), ("hi", F.max))])
    norm = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.5)
    rated = s.crossJoin(F.broadcast(span)).withColumn("composite", 0.4 * norm("mean") + 0.3 * norm("win_rate") + 0.3 * norm("profit_factor"))
    return rated.orderBy(F.desc(F.round("composite", 9)), "account_name", "symbol", "slot").limit(top).select("account_name", "symbol", "slot", "n", "mean", "win_rate", "composite")


def autocorrelation(trades: DataFrame, lags: int = 3) -> DataFrame:
    """Correlation of daily profit with that of 1 to ``lags`` trading days before, and whether it is beyond chance."""
    d = trades.groupBy("account_name", F.to_date("entry_time").alias("date")).agg(F.sum(_pnl()).alias("x"))
    w = Window.partitionBy("account_name").orderBy("date")
    lagged = d.withColumns({f"y{k}": F.lag("x", k).over(w) for k in range(1, lags + 1)})
    long = lagged.select("account_name", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"y{k}").alias("y"), F.col("x").alias("x")) for k in range(1, lags + 1)])).alias("s")).select("account_name", "s.*")
    g = long.filter("y is not null").groupBy("account_name", "lag").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    return g.withColumn("significant", F.abs("r") > 1.96 / F.sqrt("n"))


def volatility_shift(trades: DataFrame, width: int = 5, factor: float = 2.0) -> DataFrame:
    """Days around which the spread of daily profit changes by ``factor`` or more."""
    d = trades.groupBy("account_name", F.to_date("entry_time").alias("date")).agg(F.sum(_pnl()).alias("x"))
    w = Window.partitionBy("account_name").orderBy("date")
    before, after = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
    both = d.withColumns({"sb": F.stddev_pop("x").over(before), "sa": F.stddev_pop("x").over(after), "nb": F.count("*").over(before), "na": F.count("*").over(after)})
    ratio = F.col("sa") / F.nullif(F.col("sb"), F.lit(0.0))
    return both.filter((F.col("nb") == width) & (F.col("na") == width)).withColumn("ratio", ratio).filter((F.col("ratio") > factor) | (F.col("ratio") < 1 / factor)).select("account_name", "date", "ratio")


def downsampled(trades: DataFrame, points: int, *keys: str) -> DataFrame:
    """Every k-th row of each key in time order, so at most about ``points`` are left for a chart."""
    w = Window.partitionBy(*keys)
    step = F.greatest(F.floor(F.count("*").over(w) / points), F.lit(1))
    return trades.withColumn("i", F.row_number().over(w.orderBy("entry_time", "trade_id")) - 1).withColumn("k", step).filter("i % k = 0").drop("i", "k")


def latest(rows: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie))
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def common_days(trades: DataFrame, a: str, b: str) -> DataFrame:
    """Days on which both accounts traded."""
    days = lambda x: trades.filter(F.col("account_name") == x).select(F.to_date("entry_time").alias("date"))
    return days(a).intersect(days(b))


def only_first(trades: DataFrame, a: str, b: str) -> DataFrame:
    """Slots that the first account trades and the second does not."""
    s = lambda x: trades.filter(F.col("account_name") == x).select("slot")
    return s(a).distinct().exceptAll(s(b).distinct())


def stress(trades: DataFrame, shocks: dict[str, float]) -> DataFrame:
    """Profit if all losses grew by a factor, per scenario."""
    rows = trades.groupBy("account_name").agg(F.sum(F.when(_pnl() > 0, _pnl()).otherwise(0.0)).alias("gain"), F.sum(F.when(_pnl() <= 0, _pnl()).otherwise(0.0)).alias("loss"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(x).alias("factor")) for n, x in shocks.items()])).alias("s")
    return rows.select("account_name", each, "gain", "loss").select("account_name", "s.scenario", (F.col("gain") + F.col("loss") * F.col("s.factor")).alias("total"))
