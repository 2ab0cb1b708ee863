"""Walk-forward validation, permutation, live validation: folds are data, all of them in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.lineage import cut

from .simulate import hashed


def folds(trades: DataFrame, train_days: int, test_days: int, *, anchored: bool = False, at: str = "entry_time") -> DataFrame:
    """fold, train_lo, train_hi, test_lo, test_hi (half-open) over the span of the entries, or of another column."""
    span = trades.agg(F.to_date(F.min(at)).alias("lo"), F.to_date(F.max(at)).alias("hi"))
    last = F.floor((F.datediff("hi", "lo") - train_days) / test_days)
    each = span.filter(last >= 0).select("lo", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("fold"))
    shift = (F.col("fold") * test_days).cast("int")
    test_lo = F.date_add(F.date_add("lo", shift), train_days)
    return each.select("fold", (F.col("lo") if anchored else F.date_add("lo", shift)).alias("train_lo"), test_lo.alias("train_hi"), test_lo.alias("test_lo"), F.date_add(test_lo, test_days).alias("test_hi"))


def _within(partial: DataFrame, f: DataFrame, lo: str, hi: str) -> DataFrame:
    """Daily partials with every fold whose window holds their day. Folds are laid over their days, so days meet on equality."""
    days = f.select("fold", F.explode(F.sequence(F.col(lo), F.date_sub(F.col(hi), 1))).alias("day"))
    return partial.join(days, "day")


def walk_forward(trades: DataFrame, keys: list[str], *, train_days: int = 365, test_days: int = 90, min_trades: int = 3, anchored: bool = False) -> DataFrame:
    """Per fold: the best account of each cell in training, followed through the test window."""
    p = F.col("profit_loss")
    # Stored, as training, test and span would each read and join all trades again.
    partial = cut(trades.groupBy("account_name", *keys, F.to_date("entry_time").alias("day")).agg(F.sum(p).alias("pnl"), F.count("*").alias("n"), F.count_if(p > 0).alias("wins")))
    f = folds(partial, train_days, test_days, anchored=anchored, at="day")
    trained = _within(partial, f, "train_lo", "train_hi").groupBy("fold", "account_name", *keys).agg(F.sum("pnl").alias("pnl"), F.sum("n").alias("n")).filter(F.col("n") >= min_trades)
    order = Window.partitionBy("fold", *keys).orderBy(F.desc(F.round(F.col("pnl") / F.col("n"), 6)), F.asc("account_name"))
    picks = trained.withColumn("r", F.row_number().over(order)).filter("r = 1 and pnl > 0").select("fold", "account_name", *keys)
    tested = _within(partial, f, "test_lo", "test_hi").join(picks, ["fold", "account_name", *keys])
    day = tested.groupBy("fold", "day").agg(F.sum("pnl").alias("pnl"), F.sum("n").alias("n"), F.sum("wins").alias("wins"))
    return day.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("pnl").alias("total"), (F.sum("wins") / F.sum("n")).alias("win_rate"), F.count("*").alias("days"), (F.avg("pnl") / F.nullif(F.stddev_pop("pnl"), F.lit(0.0)) * F.sqrt(F.lit(252.0))).alias("sharpe"))


def live_validation(trades: DataFrame, keys: list[str], split: str) -> DataFrame:
    """Cells before a date against after it: z of the later mean, and whether it drifts."""
    old, new = F.col("entry_time") < F.lit(split).cast("timestamp_ntz"), F.col("entry_time") >= F.lit(split).cast("timestamp_ntz")
    p = F.col("profit_loss")
    g = trades.groupBy("account_name", *keys).agg(F.avg(F.when(old, p)).alias("expected"), F.stddev_samp(F.when(old, p)).alias("sigma"), F.count_if(old).alias("n_before"), F.avg(F.when(new, p)).alias("actual"), F.count_if(new).alias("n_after"))
    g = g.filter("n_before >= 5 and n_after >= 1 and sigma > 0").withColumn("z", (F.col("actual") - F.col("expected")) / (F.col("sigma") / F.sqrt(F.col("n_after"))))
    return g.withColumn("status", F.when(F.col("z") >= -1.5, "ON_TRACK").when(F.col("z") >= -2.5, "DRIFTING").otherwise("CRITICAL"))


def flip(seed: int) -> Column:
    """The sign of a value in a permutation, by hash."""
    return F.when(hashed(F.lit(seed), F.col("perm"), F.col("id")) % 2 == 0, 1.0).otherwise(-1.0)


def sign_flip(values: DataFrame, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """Share of random sign patterns whose mean is as far from zero as the values' (columns id, value).

    Every value is multiplied by its signs where it lies and summed on the map side; nothing is sent around but one sum a
    permutation and task.
    """
    signs = values.select("id", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(permutations - 1).cast("long"))).alias("perm"))
    means = signs.groupBy("perm").agg(F.avg(flip(seed) * F.abs("value")).alias("m"), F.avg("value").alias("observed"))
    return means.agg(F.first("observed").alias("observed"), F.avg((F.abs("m") >= F.abs("observed")).cast("double")).alias("p"))
