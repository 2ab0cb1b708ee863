"""Bootstrap simulation: draws are hashes of (seed, path, step), so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(trades: DataFrame, key: str) -> DataFrame:
    """Profits of each key numbered from 0."""
    w = Window.partitionBy(key).orderBy("entry_time", "trade_id")
    return trades.select(key, "profit_loss", (F.row_number().over(w) - 1).alias("i"))


def hashed(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 from the digest of the parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def draw(key: str, sizes: str, seed: int, turn: str = "step") -> Column:
    """The number drawn at a path's turn: a hash, so the same at every run and partitioning."""
    return (hashed(F.lit(seed), F.col(key), F.col("sim"), F.col(turn)) % F.col(sizes)).cast("int")


def paths(trades: DataFrame, key: str, sims: int, steps: int, seed: int = 42, block: int = 1) -> DataFrame:
    """Final profit and worst drop of every simulated path: the grid of draws is generated on the executors and joined by number.

    With ``block`` above 1, each draw is followed by the trades after it, round the end of the series, so that streaks stay
    whole. Paths are windows of ``steps`` rows.
    """
    pool = numbered(trades, key)
    sizes = trades.groupBy(key).agg(F.count("*").alias("n"))
    grid = trades.sparkSession.range(sims).withColumnRenamed("id", "sim").crossJoin(sizes)
    turns = grid.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("turn", F.floor(F.col("step") / block))
    draws = turns.withColumn("i", ((draw(key, "n", seed, "turn") + F.col("step") % block) % F.col("n")).cast("int"))
    drawn = draws.join(pool, [key, "i"])
    w = Window.partitionBy(key, "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    eq = drawn.withColumn("equity", F.sum("profit_loss").over(w)).withColumn("drop", F.greatest(F.max("equity").over(w), F.lit(0.0)) - F.col("equity"))
    return eq.groupBy(key, "sim").agg(F.sum("profit_loss").alias("final"), F.max("drop").alias("max_drop"))


def bootstrap(trades: DataFrame, key: str = "account_name", sims: int = 1000, steps: int = 100, seed: int = 42, block: int = 1) -> DataFrame:
    """Mean, sigma, percentiles and chance of loss of the simulated finals."""
    return paths(trades, key, sims, steps, seed, block).groupBy(key).agg(
        F.count("*").alias("sims"), F.avg("final").alias("mean"), F.stddev_pop("final").alias("sigma"), *[F.percentile("final", q / 100).alias(f"p{q:02d}") for q in (1, 5, 10, 25, 50, 75, 90, 95, 99)], F.avg((F.col("final") < 0).cast("double")).alias("p_loss"), F.avg("max_drop").alias("mean_drop")
    )
