"""Significance: moments in Spark, distribution functions on aggregated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import binomial_p_value, f_p_value, t_p_value, t_reach


def moments(trades: DataFrame, *keys: str) -> DataFrame:
    p = F.col("profit_loss")
    return trades.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("sigma"))


def one_sample_t(trades: DataFrame, *keys: str) -> DataFrame:
    m = moments(trades, *keys).filter("n >= 2 and sigma > 0")
    return m.withColumn("t", F.col("mean") / (F.col("sigma") / F.sqrt("n"))).withColumn("df", F.col("n") - 1)


def welch(trades: DataFrame, key: str) -> DataFrame:
    """Every two groups: difference of means, t, degrees of freedom and effect size. Groups are aggregated before the join."""
    m = moments(trades, key).filter("n >= 2 and sigma > 0")
    a, b = [m.select(*[F.col(c).alias(f"{c}_{s}") for c in (key, "n", "mean", "sigma")]) for s in "ab"]
    va, vb = F.pow("sigma_a", F.lit(2)) / F.col("n_a"), F.pow("sigma_b", F.lit(2)) / F.col("n_b")
    pooled = F.sqrt(((F.col("n_a") - 1) * F.pow("sigma_a", F.lit(2)) + (F.col("n_b") - 1) * F.pow("sigma_b", F.lit(2))) / (F.col("n_a") + F.col("n_b") - 2))
    diff = F.col("mean_a") - F.col("mean_b")
    j = a.join(b, F.col(f"{key}_a") < F.col(f"{key}_b"))
    return j.select(f"{key}_a", f"{key}_b", diff.alias("difference"), (diff / F.sqrt(va + vb)).alias("t"), (F.pow(va + vb, F.lit(2)) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))).alias("df"), (diff / pooled).alias("cohens_d"))


def with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", t_p_value(F.col("t"), F.col("df").cast("double")))


def intervals(trades: DataFrame, *keys: str, level: float = 0.95) -> DataFrame:
    """Mean with the bounds of its t interval."""
    m = moments(trades, *keys).filter("n >= 2 and sigma > 0")
    half = t_reach(level, F.col("n") - 1) * F.col("sigma") / F.sqrt("n")
    return m.withColumn("half", half).withColumns({"low": F.col("mean") - F.col("half"), "high": F.col("mean") + F.col("half")}).drop("half")


def win_rate_test(trades: DataFrame, *keys: str) -> DataFrame:
    """Exact one-sided binomial test of a win rate above a half."""
    g = trades.groupBy(*keys).agg(F.count("profit_loss").alias("n"), F.count_if(F.col("profit_loss") > 0).alias("wins"))
    return g.withColumn("p", binomial_p_value(F.col("wins"), F.col("n")))


def one_way(trades: DataFrame, group: str, *keys: str) -> DataFrame:
    """One-way analysis of variance of profits by ``group``, from the moments of the groups."""
    n, m = F.col("n"), F.col("mean")
    g = moments(trades.filter(F.col("profit_loss").isNotNull()), *keys, group)
    total = g.groupBy(*keys).agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(n * m * m).alias("a"), F.sum(n * m).alias("b"), F.sum((n - 1) * F.coalesce(F.pow("sigma", F.lit(2)), F.lit(0.0))).alias("within"))
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    total = total.filter((d1 > 0) & (d2 > 0) & (F.col("within") > 0)).withColumn("f", (F.col("a") - F.col("b") * F.col("b") / F.col("n")) / d1 / (F.col("within") / d2))
    return total.withColumn("p", f_p_value(F.col("f"), d1, d2)).select(*keys, "groups", "n", "f", "p")


def month_stability(trades: DataFrame, *keys: str) -> DataFrame:
    """How a cell's mean of one month foretells that of its next month of trading: correlation, share explained, share of equal signs."""
    months = trades.groupBy("account_name", *keys, F.date_format("entry_time", "yyyy-MM").alias("month")).agg(F.avg("profit_loss").alias("mean"))
    pairs = months.withColumn("later", F.lead("mean").over(Window.partitionBy("account_name", *keys).orderBy("month"))).filter("later is not null")
    same = F.signum("mean") == F.signum("later")
    return pairs.groupBy("account_name").agg(F.count("*").alias("pairs"), F.corr("mean", "later").alias("persistence"), F.regr_r2("later", "mean").alias("r2"), F.avg(same.cast("double")).alias("hit_ratio"))


def needed_trades(trades: DataFrame, *keys: str, z: float = 1.959964 + 0.841621) -> DataFrame:
    """Trades that a mean of this size needs to be told from zero (by default: 5 %, two-sided, with a power of 80 %)."""
    m = moments(trades, *keys).filter("n >= 2 and sigma > 0 and mean <> 0").withColumn("effect", F.col("mean") / F.col("sigma"))
    return m.select(*keys, "n", "effect", F.ceil(F.pow(z / F.col("effect"), F.lit(2))).alias("needed"))


def feature_scores(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Each feature with its correlation with the target and the F statistic of a regression on it alone."""
    sums = rows.agg(*[F.corr(f, target).alias(f) for f in features], *[F.count_if(F.col(f).isNotNull() & F.col(target).isNotNull()).alias(f"n_{f}") for f in features])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation"), F.col(f"n_{f}").alias("n")) for f in features]))
    r2 = F.col("correlation") * F.col("correlation")
    return sums.select(each.alias("x")).select("x.*").withColumn("f", r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2))
