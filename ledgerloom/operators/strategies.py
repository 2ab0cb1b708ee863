"""Strategies that recommend cells, their votes, how well they foretell trades, and alerts that last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import adjusted_p
from .significance import moments, win_rate_test

#: Fixed weights of the strategies in the vote.
WEIGHTS = {"statistical": 0.4, "persistence": 0.35, "likelihood": 0.25}


def verdicts(trades: DataFrame, keys: list[str], *, min_trades: int = 5) -> DataFrame:
    """What each strategy says of each cell: ``strategy``, ``confidence`` (0 to 1) and ``recommends``.

    ``statistical``: the mean is above zero by more than a standard error. ``persistence``: 60 % or more of the months gain.
    ``likelihood``: more than half of the trades gain. A cell is aggregated once by month; the strategies share that row.
    """
    p = F.col("profit_loss")
    months = trades.groupBy(*keys, F.date_format("entry_time", "yyyy-MM").alias("month")).agg(F.sum(p).alias("s"), F.sum(p * p).alias("ss"), F.count(p).alias("k"), F.count_if(p > 0).alias("w"))
    cells = months.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("k").alias("n"), F.sum("w").alias("w"), F.avg((F.col("s") > 0).cast("double")).alias("persistence")).filter(F.col("n") >= min_trades)
    n = F.col("n")
    sigma = F.sqrt(F.greatest((F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1), F.lit(0.0)))
    t = F.coalesce(F.col("s") / n / F.nullif(sigma / F.sqrt(n), F.lit(0.0)), F.lit(0.0))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    said = [("statistical", clip(t / 3), t > 1), ("persistence", F.col("persistence"), F.col("persistence") >= 0.6), ("likelihood", F.col("w") / n, F.col("w") / n > 0.5)]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), c.alias("confidence"), r.alias("recommends")) for s, c, r in said]))
    return cells.select(*keys, "n", each.alias("x")).select(*keys, "n", "x.*")


def vote(said: DataFrame, keys: list[str], weights: dict[str, float] = WEIGHTS, least: float = 0.5) -> DataFrame:
    """Weighted vote of the strategies; a cell is chosen when the strategies for it weigh ``least`` or more."""
    w = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(x)) for s, x in weights.items()], F.lit(0.0))
    g = said.groupBy(*keys).agg(F.sum(w * F.col("recommends").cast("int")).alias("weight"), F.sum(w * F.col("confidence")).alias("confidence"), F.count_if("recommends").alias("votes"))
    return g.withColumn("chosen", F.col("weight") >= least - 1e-9)


def evaluated(trades: DataFrame, said: DataFrame, keys: list[str]) -> DataFrame:
    """How well each strategy's word foretells that a trade gains: accuracy, precision, recall, F1, composite and rank."""
    hit, call = F.col("profit_loss") > 0, F.col("recommends")
    cells = trades.groupBy(*keys).agg(F.count_if(hit).alias("gains"), F.count_if(~hit).alias("others"))
    j = cells.join(said.select(*keys, "strategy", "recommends"), keys)
    side = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(0))
    g = j.groupBy("strategy").agg(side("gains", call).alias("tp"), side("others", call).alias("fp"), side("gains", ~call).alias("fn"), side("others", ~call).alias("tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    g = g.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    g = g.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("composite", (F.col("accuracy") + F.col("precision") + F.col("recall") + F.col("f1")) / 4)
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("composite", 9)), "strategy")))


def sustained(snaps: DataFrame, condition: Column, at_least: str, *keys: str) -> DataFrame:
    """Alerts: a condition that holds at consecutive snapshots over ``at_least`` of time or more; from, to, and when it was resolved.

    ``resolved`` is the first snapshot after it, null while the alert still stands.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    bad = F.coalesce(condition, F.lit(False))
    s = snaps.withColumn("bad", bad).withColumn("next", F.lead("start").over(w))
    s = s.withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("bad")
    a = s.groupBy(*keys, "island").agg(F.min("start").alias("since"), F.max("start").alias("until"), F.count("*").alias("snapshots"), F.max_by("next", "start").alias("resolved"))
    return a.filter(F.col("until") >= F.col("since") + F.expr(f"INTERVAL {at_least}")).drop("island")


def retained(rows: DataFrame, time_col: str, keep: str) -> DataFrame:
    """Rows no older than ``keep`` before the newest one."""
    newest = rows.agg(F.max(time_col).alias("_newest"))
    return rows.crossJoin(F.broadcast(newest)).filter(F.col(time_col) >= F.col("_newest") - F.expr(f"INTERVAL {keep}")).drop("_newest")


def foreseen(trades: DataFrame, keys: list[str], cut: str) -> DataFrame:
    """Frozen audit: cells whose mean was above zero before ``cut``, and what all trades of those cells made after it."""
    old = F.col("entry_time") < F.lit(cut).cast("timestamp_ntz")
    chosen = moments(trades.filter(old), *keys).filter("n >= 5 and mean > 0").select(*keys, F.col("mean").alias("expected"))
    after = moments(trades.filter(~old), *keys).select(*keys, "n", "mean")
    return chosen.join(after, keys)


def significant(trades: DataFrame, keys: list[str], *, min_trades: int = 30, rate: float = 0.05) -> DataFrame:
    """Cells with enough trades, the exact one-sided p of their win rate, its false-discovery-rate adjusted value within the account,
    and ``selected``: adjusted value of ``rate`` at most, half of the trades or more gain, and the mean is above zero."""
    means = moments(trades, "account_name", *keys).select("account_name", *keys, "mean")
    tested = win_rate_test(trades, "account_name", *keys).filter(F.col("n") >= min_trades).join(means, ["account_name", *keys])
    q = adjusted_p(tested.withColumn("id", F.struct(*keys)), ["account_name"]).drop("id")
    return q.withColumn("selected", (F.col("q") <= rate) & (2 * F.col("wins") >= F.col("n")) & (F.col("mean") > 0))
