"""Edges: accounts that trade a cell best, by persistence, followed forward over months, and what following them gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.lineage import cut

from .slots import CELL, fresh, reliability, winners

ORDERS = {
    "classic": [F.desc, "mean", F.desc, "win_rate"],
    "persistence": [F.desc, "persistence", F.desc, "mean", F.desc, "win_rate"],
    "statistical": [F.desc, "edge", F.desc, "mean"],
    "steady": [F.desc, "win_rate", F.desc, "mean"],
}


def ordering(kind: str) -> list[Column]:
    """Order keys of a ranking: by mean profit, by persistence, by mean profit times win rate, or by win rate."""
    keys = ORDERS[kind]
    return [way(name) for way, name in zip(keys[::2], keys[1::2], strict=True)]


def cell_stats(trades: DataFrame, min_trades: int = 3, sentinel: float = 99.0) -> DataFrame:
    """Statistics of every account and cell with its monthly persistence (percent of months that gained) and ``edge``.

    Months carry all sums that the statistics need, so trades are read and dealt once; what meets by cell are months.
    """
    p = F.col("profit_loss")
    won, lost = F.when(p > 0, p), F.when(p <= 0, p)
    monthly = trades.groupBy("account_name", *CELL, F.date_format("entry_time", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.sum(p).alias("pnl"), F.sum(p * p).alias("square"), F.count_if(p > 0).alias("wins"), F.count(p).alias("known"), F.sum(won).alias("won"), F.sum(lost).alias("lost"), F.count(lost).alias("losses"), F.max(p).alias("best"), F.min(p).alias("worst")
    )
    total, n, known = F.sum("pnl"), F.sum("n"), F.sum("known")
    stats = monthly.groupBy("account_name", *CELL).agg(
        n.alias("n"),
        total.alias("total"),
        (total / F.nullif(known, F.lit(0))).alias("mean"),
        (100.0 * F.sum("wins") / n).alias("win_rate"),
        (F.sum("won") / F.nullif(F.sum("wins"), F.lit(0))).alias("avg_winner"),
        (F.sum("lost") / F.nullif(F.sum("losses"), F.lit(0))).alias("avg_loser"),
        F.max("best").alias("best"),
        F.min("worst").alias("worst"),
        F.when(F.coalesce(F.abs(F.sum("lost")), F.lit(0.0)) > 0, F.coalesce(F.sum("won"), F.lit(0.0)) / F.abs(F.sum("lost"))).otherwise(F.lit(sentinel)).alias("profit_factor"),
        (F.sum("square") / F.nullif(known, F.lit(0))).alias("mean_square"),
        (100.0 * F.count_if(F.col("pnl") > 0) / F.count("*")).alias("persistence"),
        F.count("*").alias("months"),
    )
    stats = stats.filter(F.col("n") >= min_trades)
    return stats.withColumn("edge", F.col("mean") * F.col("win_rate") / 100).withColumn("reliability", reliability(F.col("mean"), F.col("mean_square"), F.col("n")))


def matrix(trades: DataFrame, order: str = "persistence", *, days: int = 30, min_trades: int = 3, min_mean: float = 0.0, min_win_rate: float = 0.0, min_persistence: float = 0.0) -> DataFrame:
    """Best account of every cell among accounts that traded lately. Limits apply after ranking, so a weak winner empties its cell."""
    good = (F.col("mean") > min_mean) & (F.col("win_rate") >= min_win_rate) & (F.col("persistence") >= min_persistence)
    return winners(cell_stats(fresh(trades, days), min_trades), ordering(order)).filter(good)


def labelled(best: DataFrame, trades: DataFrame, *, days: int = 30, least: int = 5, banned: tuple[str, ...] = ()) -> DataFrame:
    """A matrix with status and health of each cell by its trades of the last ``days``; cells without any, and banned accounts, go."""
    now = trades.agg(F.max("entry_time").alias("now"))
    late = trades.crossJoin(F.broadcast(now)).filter(F.col("entry_time") >= F.col("now") - F.make_dt_interval(days=F.lit(days)))
    recent = late.groupBy("account_name", *CELL).agg(F.avg("profit_loss").alias("recent_mean"), F.count("*").alias("recent_n"))
    few = F.col("recent_n") < least
    status = F.when(few, "STABLE").when(F.col("recent_mean") >= 0.9 * F.col("mean"), "STABLE").when(F.col("recent_mean") > 0, "DRIFTING").otherwise("CRITICAL")
    health = F.when(few, 90).when(status == "STABLE", 100).when(status == "DRIFTING", 70).otherwise(30)
    return best.filter(~F.col("account_name").isin(*banned)).join(recent, ["account_name", *CELL]).withColumn("status", status).withColumn("health", health)


def followed(trades: DataFrame, best: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Trades of the recommended account of their cell."""
    return trades.join(best.select("account_name", *keys), ["account_name", *keys], "left_semi")


def uncrowded(trades: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """Trades of an account, cell and day on which it traded at most ``most`` times. Days are counted, then joined."""
    day = F.to_date("entry_time")
    busy = trades.groupBy("account_name", *keys, day.alias("_day")).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).drop("_n")
    return trades.withColumn("_day", day).join(busy, ["account_name", *keys, "_day"], "left_anti").drop("_day")


def daily_equity(trades: DataFrame) -> DataFrame:
    """Profit of every day, and the running profit: a window over days, of which there are few."""
    day = trades.groupBy(F.to_date("entry_time").alias("date")).agg(F.sum("profit_loss").alias("pnl"), F.count("*").alias("n"))
    return day.withColumn("equity", F.sum("pnl").over(Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def combined_stats(trades: DataFrame) -> DataFrame:
    """One row over followed trades: sums, averages, annualised sharpe and sortino (sample sigma; losses against the mean), worst
    drop of the equity by day."""
    p = F.col("profit_loss")
    moments = trades.agg(F.count("*").alias("n"), F.sum(p).alias("total"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("sigma"), (100.0 * F.count_if(p > 0) / F.count("*")).alias("win_rate"), F.avg(F.when(p > 0, p)).alias("avg_winner"), F.avg(F.when(p < 0, p)).alias("avg_loser"), (F.sum(F.when(p > 0, p)) / F.nullif(F.abs(F.sum(F.when(p < 0, p))), F.lit(0.0))).alias("profit_factor"), F.count_distinct(F.to_date("entry_time")).alias("days"))
    below = trades.crossJoin(F.broadcast(moments.select("mean"))).agg(F.sum(F.pow(F.least(p - F.col("mean"), F.lit(0.0)), F.lit(2))).alias("down"))
    days = daily_equity(trades)
    peak = F.greatest(F.max("equity").over(Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    drop = days.withColumn("drop", peak - F.col("equity")).agg(F.max("drop").alias("worst_drop"))
    year = F.sqrt(F.col("n") / F.col("days") * 252)
    out = moments.crossJoin(F.broadcast(below)).crossJoin(F.broadcast(drop))
    return out.select("n", "total", "mean", "win_rate", "avg_winner", "avg_loser", "profit_factor", "days", (F.col("mean") / F.nullif(F.col("sigma"), F.lit(0.0)) * year).alias("sharpe"), (F.col("mean") / F.nullif(F.sqrt(F.col("down") / (F.col("n") - 1)), F.lit(0.0)) * year).alias("sortino"), "worst_drop")


def cell_days(trades: DataFrame, keys: list[str]) -> DataFrame:
    """One row an account, cell and day, with its ``month`` and what folds need of its trades: their number, that of known profits and
    of wins, the profit, its least and most, and the parts of its squares within and between days (``inner``, ``outer``).

    All folds and logics meet days and never trades, of which there may be any number in a day. So trades are read and dealt once, and
    days are stored."""
    p, known = F.col("profit_loss"), F.count("profit_loss")
    days = trades.groupBy("account_name", *keys, F.to_date("entry_time").alias("day")).agg(
        F.count("*").alias("n"), known.alias("known"), F.count_if(p > 0).alias("wins"), F.sum(p).alias("pnl"), F.min(p).alias("least"), F.max(p).alias("most"), (F.var_pop(p) * known).alias("inner"), (F.sum(p) * F.avg(p)).alias("outer")
    )
    return cut(days.withColumn("month", F.date_format("day", "yyyy-MM")))


def month_windows(days: DataFrame, train: int, test: int, expanding: bool) -> DataFrame:
    """fold, role (train or test) and month of a walk-forward over the months that have trades. Months are few."""
    months = days.select("month").distinct()
    held = months.agg(F.array_sort(F.collect_list("month")).alias("all"))
    last = F.floor((F.size("all") - train - test) / test).cast("int")
    each = held.filter(last >= 0).select("all", F.explode(F.sequence(F.lit(0), last)).alias("fold"))
    begin = F.lit(0) if expanding else F.col("fold") * test
    span = lambda role, a, n: F.transform(F.slice("all", a + 1, n), lambda m: F.struct(F.lit(role).alias("role"), m.alias("month")))
    rows = F.concat(span("train", begin, F.col("fold") * test + train - begin), span("test", F.col("fold") * test + train, F.lit(test)))
    return each.select("fold", F.explode(rows).alias("x")).select("fold", "x.role", "x.month")


def qualifies(logic: str, min_persistence: float) -> Column:
    """Whether a cell's training months qualify its account: persistence, classic (mean over 10), or statistical."""
    gained, enough = F.col("pnl") > 0, F.col("n") >= 5
    if logic == "persistence":
        return (F.col("persistence") >= min_persistence) & gained & enough & (F.col("months") >= 2)
    if logic == "classic":
        return gained & (F.col("pnl") / F.col("n") > 10) & enough
    return gained & (F.col("persistence") > 50) & enough


def month_picks(days: DataFrame, keys: list[str], *, train: int = 6, test: int = 1, expanding: bool = False, logic: str = "persistence", min_persistence: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Picks (fold, account, cell) of every fold by its training months, and the windows. All folds are one plan over monthly sums of
    :func:`cell_days`."""
    windows = month_windows(days, train, test, expanding)
    monthly = days.groupBy("account_name", *keys, "month").agg(F.sum("pnl").alias("pnl"), F.sum("n").alias("n"))
    seen = monthly.join(windows.filter("role = 'train'"), "month").groupBy("fold", "account_name", *keys)
    rated = seen.agg(F.sum("pnl").alias("pnl"), F.sum("n").alias("n"), F.count("*").alias("months"), (100.0 * F.count_if(F.col("pnl") > 0) / F.count("*")).alias("persistence")).filter(qualifies(logic, min_persistence))
    order = Window.partitionBy("fold", *keys).orderBy(F.desc("persistence"), F.desc(F.round("pnl", 6)), "account_name")
    return rated.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r"), windows


def month_days(days: DataFrame, keys: list[str], *, most: int = 200, **options) -> DataFrame:
    """Days (:func:`cell_days`) of the test months that follow their fold's picks, crowded ones left out, with the fold."""
    picks, windows = month_picks(days, keys, **options)
    tested = days.filter(F.col("n") <= most).join(windows.filter("role = 'test'").select("fold", "month"), "month")
    return tested.join(picks.select("fold", "account_name", *keys), ["fold", "account_name", *keys], "left_semi")


def month_trades(trades: DataFrame, keys: list[str], **options) -> DataFrame:
    """Trades of the test months that follow their fold's picks, crowded days left out, with the fold and the month."""
    days = month_days(cell_days(trades, keys), keys, **options)
    return trades.withColumn("_day", F.to_date("entry_time")).join(days.select("account_name", *keys, F.col("day").alias("_day"), "fold", "month"), ["account_name", *keys, "_day"]).drop("_day")


def _moments(of: Column | None = None) -> tuple[Column, Column, Column, Column]:
    """Known profits of days (:func:`cell_days`; of those where ``of`` holds), their mean, share of wins, and sample sigma."""
    own = lambda f, c: f(F.col(c) if of is None else F.when(of, F.col(c)))
    n, s = own(F.sum, "known"), own(F.sum, "pnl")
    some = F.nullif(n, F.lit(0))
    # Profits that are all alike have no spread; rounding may not lend them one.
    spread = F.when(own(F.min, "least") == own(F.max, "most"), 0.0).otherwise(F.greatest(own(F.sum, "inner") + own(F.sum, "outer") - s * s / some, F.lit(0.0)))
    return F.coalesce(n, F.lit(0)), s / some, own(F.sum, "wins") / some, F.when(n > 1, F.sqrt(spread / F.nullif(n - 1, F.lit(0))))


def fold_metrics(days: DataFrame, by: str = "fold") -> DataFrame:
    """Trades, profit, win rate, mean, sigma and sharpe (mean over sigma) by fold, of days (:func:`month_days`)."""
    _, mean, _, sigma = _moments()
    return days.groupBy(by).agg(F.sum("n").alias("n"), F.sum("pnl").alias("total"), (F.sum("wins") / F.sum("n")).alias("win_rate"), mean.alias("mean"), sigma.alias("volatility"), (mean / F.nullif(sigma, F.lit(0.0))).alias("sharpe"))


def degradation(trades: DataFrame, keys: list[str], *, threshold: float = 0.3, **options) -> DataFrame:
    """Per fold: how much win rate, mean, sharpe and volatility of the picks' trades lose from training to test, and robustness.

    Robustness weighs the mean loss of sharpe, win rate and mean against ``threshold`` (0.4), the test's sharpe up to 1 (0.3),
    and its win rate between 0.5 and 0.6 (0.3).
    """
    days = cell_days(trades, keys)
    picks, windows = month_picks(days, keys, **options)
    role = days.join(windows, "month").join(picks.select("fold", "account_name", *keys), ["fold", "account_name", *keys], "left_semi")
    size = lambda c: F.coalesce(c, F.lit(0.0))
    in_, out = _moments(F.col("role") == "train"), _moments(F.col("role") == "test")
    each = lambda m: [size(m[1] / F.nullif(m[3], F.lit(0.0))), m[2], m[1], size(m[3])]
    names = ["sharpe", "win_rate", "mean", "volatility"]
    both = role.groupBy("fold").agg(*[c.alias(f"{n}_in") for n, c in zip(names, each(in_), strict=True)], *[c.alias(f"{n}_out") for n, c in zip(names, each(out), strict=True)], out[0].alias("n_out")).filter("n_out > 0")
    loss = lambda n: F.coalesce((F.col(f"{n}_in") - F.col(f"{n}_out")) * (-1 if n == "volatility" else 1) / F.nullif(F.abs(F.col(f"{n}_in")), F.lit(0.0)), F.lit(0.0))
    lost = both.select("fold", "n_out", "sharpe_out", "win_rate_out", *[loss(n).alias(f"{n}_loss") for n in names])
    mean_loss = (F.abs("sharpe_loss") + F.abs("win_rate_loss") + F.abs("mean_loss")) / 3
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    score = 0.4 * F.greatest(1 - mean_loss / threshold, F.lit(0.0)) + 0.3 * clip(F.col("sharpe_out")) + 0.3 * clip((F.col("win_rate_out") - 0.5) / 0.1)
    return lost.withColumn("robustness", score)


def compared_logics(trades: DataFrame, keys: list[str], logics: tuple[str, ...] = ("persistence", "classic", "statistical"), **options) -> DataFrame:
    """Logics side by side over the same folds: profit, share of folds that gained (consistency), sharpe, and a score.

    The score is consistency, plus 20 (all folds gain) or 10 (over 70 percent do), plus 5 times the sharpe of the folds.
    """
    out, days = None, cell_days(trades, keys)
    for logic in logics:
        folds = fold_metrics(month_days(days, keys, logic=logic, **options)).select(F.lit(logic).alias("logic"), "fold", "total")
        out = folds if out is None else out.unionByName(folds)
    rated = out.groupBy("logic").agg(F.count("*").alias("folds"), F.sum("total").alias("total"), (100.0 * F.count_if(F.col("total") > 0) / F.count("*")).alias("consistency"), F.coalesce(F.avg("total") / F.nullif(F.stddev_pop("total"), F.lit(0.0)), F.lit(0.0)).alias("sharpe"))
    bonus = F.when(F.col("consistency") >= 100, 20).when(F.col("consistency") >= 70, 10).otherwise(0)
    return rated.withColumn("score", F.col("consistency") + bonus + 5 * F.col("sharpe"))
