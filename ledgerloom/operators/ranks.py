"""Rank statistics without a group in one task: values are counted first, then placed within bins of their range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import normal_cdf

from .scans import count_below


def places(rows: DataFrame, keys: list[str], value: str, bins: int = 256, **sums: Column) -> DataFrame:
    """One row for every different value of a key: ``ties``, the mean ``place`` of its ties (from 1), and the aggregates ``sums``.

    A key's values are cut into ``bins`` at their approximate quantiles (error at most one in 10,000 of the key's rows), so bins hold
    about equally many rows however the values lie, but for ties, which are one row here. Only bin totals pass through a window over
    the key; values are put in order within their bin. Bins need only be balanced: places are exact. Nulls are left out.
    """
    known = rows.filter(F.col(value).isNotNull())
    edges = known.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(k / bins) for k in range(1, bins)]) if bins > 1 else F.array(F.lit(1.0)), F.lit(10_000)).alias("_edges"))
    binned = count_below(known.join(edges, keys), "_bin", "_edges", F.col(value), bins)
    counted = binned.groupBy(*keys, "_bin", value).agg(F.count("*").alias("ties"), *[c.alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(*keys, "_bin").agg(F.sum("ties").alias("_n"))
    offsets = totals.select(*keys, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    upto = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.join(offsets, [*keys, "_bin"]).withColumn("place", F.col("_before") + F.sum("ties").over(upto) - (F.col("ties") - 1) / 2)
    return placed.drop("_bin", "_before")


def _two_sided(z: Column) -> Column:
    return 2 * normal_cdf(-F.abs(z))


def _tie_term() -> Column:
    t = F.col("ties").cast("double")
    return F.sum(t * t * t - t)


def signed_rank(trades: DataFrame, *keys: str) -> DataFrame:
    """Wilcoxon's signed-rank test of a zero median, normal approximation with ties; profits of zero are left out."""
    moved = trades.filter("profit_loss <> 0").withColumn("size", F.abs("profit_loss"))
    ranked = places(moved, list(keys), "size", gains=F.count_if(F.col("profit_loss") > 0))
    n = F.col("n")
    g = ranked.groupBy(*keys).agg(F.sum("ties").alias("n"), F.sum(F.col("place") * F.col("gains")).alias("w"), _tie_term().alias("t"))
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(F.nullif(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48, F.lit(0.0)))
    return g.withColumn("z", z).withColumn("p", _two_sided(F.col("z"))).drop("t")


def rank_sum(trades: DataFrame, first: Column, *keys: str) -> DataFrame:
    """Mann and Whitney's test of the trades for which ``first`` holds against the others, normal approximation with ties."""
    marked = trades.withColumn("_first", F.coalesce(first, F.lit(False)))
    ranked = places(marked, list(keys), "profit_loss", k=F.count_if("_first"))
    a, b = F.col("n_first"), F.col("n_other")
    g = ranked.groupBy(*keys).agg(F.sum("k").alias("n_first"), F.sum(F.col("ties") - F.col("k")).alias("n_other"), F.sum(F.col("place") * F.col("k")).alias("r"), _tie_term().alias("t"))
    n = a + b
    spread = a * b / 12 * (n + 1 - F.col("t") / F.nullif(n * (n - 1), F.lit(0)))
    g = g.withColumn("u", F.col("r") - a * (a + 1) / 2).withColumn("z", (F.col("u") - a * b / 2) / F.sqrt(F.nullif(spread, F.lit(0.0))))
    return g.withColumn("p", _two_sided(F.col("z"))).drop("r", "t")


def normality(trades: DataFrame, *keys: str) -> DataFrame:
    """Distance from the fitted normal distribution: Jarque and Bera's statistic with its p value, Kolmogorov and Smirnov's distance."""
    p = F.col("profit_loss")
    fit = trades.groupBy(*keys).agg(F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("sigma"), F.skewness(p).alias("skew"), F.kurtosis(p).alias("excess")).filter("n >= 3 and sigma > 0")
    x = normal_cdf((p - F.col("mean")) / F.col("sigma"))
    high, low = F.col("place") + (F.col("ties") - 1) / 2, F.col("place") - (F.col("ties") + 1) / 2
    far = F.greatest(F.abs(high / F.col("n") - x), F.abs(x - low / F.col("n")))
    distance = places(trades, list(keys), "profit_loss").join(fit.select(*keys, "n", "mean", "sigma"), list(keys)).groupBy(*keys).agg(F.max(far).alias("ks"))
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("excess") * F.col("excess") / 4)
    return fit.withColumn("jarque_bera", jb).withColumn("p", F.exp(-F.col("jarque_bera") / 2)).join(distance, list(keys))


def tails(trades: DataFrame, *keys: str, level: float = 0.95) -> DataFrame:
    """Tail of the losses: value at risk (the smallest loss that ``level`` of the trades do not pass), mean loss beyond it, and the
    generalised Pareto shape and scale of the excess by the method of moments."""
    ranked = places(trades.withColumn("loss", -F.col("profit_loss")), list(keys), "loss")
    sizes = trades.filter("profit_loss is not null").groupBy(*keys).agg(F.count("*").alias("n"))
    high = F.col("place") + (F.col("ties") - 1) / 2
    at = ranked.join(sizes, list(keys)).filter(high >= level * F.col("n"))
    risk = at.groupBy(*keys).agg(F.min("loss").alias("var"))
    t = F.col("ties").cast("double")
    e = F.col("loss") - F.col("var")
    beyond = at.join(risk, list(keys)).filter("loss > var").groupBy(*keys, "n", "var").agg(F.sum(t).alias("k"), F.sum(t * e).alias("s"), F.sum(t * e * e).alias("ss"))
    m = F.col("s") / F.col("k")
    v = F.nullif((F.col("ss") - F.col("k") * m * m) / F.nullif(F.col("k") - 1, F.lit(0.0)), F.lit(0.0))
    ratio = m * m / v
    return beyond.select(*keys, "n", "var", F.col("k").cast("long").alias("beyond"), (F.col("var") + m).alias("expected_shortfall"), ((1 - ratio) / 2).alias("shape"), (m * (1 + ratio) / 2).alias("scale"))
