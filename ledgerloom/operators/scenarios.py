"""Scenarios drawn by hash: correlated accounts, mixtures, and chains of market regimes. Every draw is the same in every engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.gammas import normal_quantile_sql

from .market import daily
from .simulate import hashed


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from the digest of the parts."""
    return (hashed(*parts) + 0.5) / float(1 << 32)


def standard_normal(df: DataFrame, name: str, *parts: Column) -> DataFrame:
    """Adds a draw of the normal distribution under ``name``."""
    return df.withColumn("_u", uniform(*parts)).withColumn(name, F.expr(normal_quantile_sql("_u"))).drop("_u")


def nearest_positive(matrix: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """The matrix itself if it is positive definite, else with eigenvalues of at least ``least`` and a diagonal of ones."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    if values[0] >= least:
        return matrix
    fixed = (vectors * np.maximum(values, least)) @ vectors.T
    scale = 1 / np.sqrt(np.diag(fixed))
    return fixed * np.outer(scale, scale)


def account_moments(trades: DataFrame, most: int = 200) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Accounts, means, sigmas and correlations (0 where undefined) of daily profits; a day without trades counts as 0.

    A matrix of all accounts is made on the driver, so more than ``most`` accounts are an error. Days are aggregated first; the
    pairs of a day are at most ``most`` squared.
    """
    if len(trades.select("account_name").distinct().limit(most + 1).collect()) > most:
        raise ValueError(f"more than {most} accounts")
    d = daily(trades)
    n = d.select("date").distinct().count()
    a, b = d.select("date", F.col("account_name").alias("a"), F.col("pnl").alias("x")), d.select("date", F.col("account_name").alias("b"), F.col("pnl").alias("y"))
    rows = a.join(b, "date").filter("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy")).collect()
    sums = {r.a: r.s for r in a.groupBy("a").agg(F.sum("x").alias("s")).collect()}
    names = sorted(sums)
    at = {k: i for i, k in enumerate(names)}
    mean = np.array([sums[k] / n for k in names])
    cov = np.zeros((len(names), len(names)))
    for r in rows:
        i, j = at[r.a], at[r.b]
        cov[i, j] = cov[j, i] = (r.xy - n * mean[i] * mean[j]) / max(n - 1, 1)
    sigma = np.sqrt(np.maximum(np.diag(cov), 0))
    safe = np.where(sigma > 0, sigma, 1)
    corr = np.where(np.outer(sigma, sigma) > 0, cov / np.outer(safe, safe), 0.0)
    np.fill_diagonal(corr, 1.0)
    return names, mean, sigma, corr


def correlated(trades: DataFrame, sims: int, days: int, seed: int = 42, most: int = 200) -> DataFrame:
    """Profit of every account on every day of every scenario: normals that correlate as the accounts' daily profits do.

    The correlation matrix is repaired to the nearest positive definite one and factored; its factor (at most ``most`` squared
    numbers) goes to the executors, where each scenario's day mixes its own independent normals.
    """
    spark = trades.sparkSession
    names, mean, sigma, corr = account_moments(trades, most)
    factor = np.linalg.cholesky(nearest_positive(corr)) if names else np.zeros((0, 0))
    rows = [(a, b, float(mean[i]), float(sigma[i]), float(factor[i, j])) for i, a in enumerate(names) for j, b in enumerate(names[: i + 1])]
    weights = spark.createDataFrame(rows, "account_name string, source string, mean double, sigma double, weight double")
    grid = spark.range(sims).withColumnRenamed("id", "sim").withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    drawn = standard_normal(grid.withColumn("source", F.explode(F.array(*[F.lit(a) for a in names]) if names else F.array().cast("array<string>"))), "z", F.lit(seed), F.col("source"), F.col("sim"), F.col("day"))
    mixed = drawn.join(F.broadcast(weights), "source").groupBy("sim", "day", "account_name").agg(F.sum(F.col("weight") * F.col("z")).alias("z"), F.max("mean").alias("mean"), F.max("sigma").alias("sigma"))
    return mixed.select("sim", "day", "account_name", (F.col("mean") + F.col("sigma") * F.col("z")).alias("pnl"))


def mixture_paths(fits: DataFrame, sims: int, steps: int, seed: int = 42) -> DataFrame:
    """Finals of paths drawn from each key's fitted mixture (see :func:`ledgerloom.operators.fits.mixtures`): one draw picks the part,
    another the value. Paths are summed where they are drawn, nothing but finals is sent around."""
    grid = fits.select("key", "w", "m1", "v1", "m2", "v2", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    drawn = standard_normal(grid, "z", F.lit(seed), F.col("key"), F.col("sim"), F.col("step"), F.lit("z"))
    first = uniform(F.lit(seed), F.col("key"), F.col("sim"), F.col("step"), F.lit("part")) < F.col("w")
    value = F.when(first, F.col("m1") + F.sqrt("v1") * F.col("z")).otherwise(F.col("m2") + F.sqrt("v2") * F.col("z"))
    return drawn.groupBy("key", "sim").agg(F.sum(value).alias("final"))


def regime_paths(by_regime: DataFrame, transitions: DataFrame, sims: int, steps: int, start: str, seed: int = 42) -> DataFrame:
    """Finals of paths through a chain of regimes: ``by_regime`` has key, regime, mean and sigma; ``transitions`` regime, to_regime,
    share (a few rows).

    The chain of a scenario is one fold over its steps, in one row, so it needs no shuffle; all keys of a scenario share it. A
    regime without a successor stays; a key without trades in a regime gains nothing there.
    """
    spark = by_regime.sparkSession
    total = F.struct("to_regime", "share")
    table = transitions.groupBy("regime").agg(F.array_sort(F.collect_list(total)).alias("moves")).agg(F.map_from_entries(F.collect_list(F.struct("regime", "moves"))).alias("moves"))
    us = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda s: uniform(F.lit(seed), F.lit("regime"), F.col("sim"), s))
    known = spark.range(sims).withColumnRenamed("id", "sim").crossJoin(F.broadcast(table)).withColumn("us", us)

    def moved(state: Column, u: Column) -> Column:
        moves = F.element_at(F.col("moves"), state)
        nothing = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("to"))
        found = F.aggregate(moves, nothing, lambda a, x: F.struct((a["sum"] + x["share"]).alias("sum"), F.coalesce(a["to"], F.when(u < a["sum"] + x["share"], x["to_regime"])).alias("to")), lambda a: a["to"])
        return F.coalesce(found, F.element_at(F.transform(moves, lambda x: x["to_regime"]), -1), state)

    chain = F.aggregate("us", F.array(F.lit(start)), lambda path, u: F.concat(path, F.array(moved(F.element_at(path, -1), u))))
    walked = known.select("sim", F.posexplode(F.slice(chain, 2, steps)).alias("step", "regime"))
    drawn = standard_normal(walked.join(F.broadcast(by_regime), "regime"), "z", F.lit(seed), F.col("key"), F.col("sim"), F.col("step"))
    return drawn.groupBy("key", "sim").agg(F.sum(F.col("mean") + F.coalesce("sigma", F.lit(0.0)) * F.col("z")).alias("final"), F.count("*").alias("steps"))


def finals_summary(finals: DataFrame) -> DataFrame:
    """By key: scenarios, mean, sigma, the 5th, 50th and 95th percentile, and the chance of a loss."""
    return finals.groupBy("key").agg(F.count("*").alias("sims"), F.avg("final").alias("mean"), F.stddev_samp("final").alias("sigma"), *[F.percentile("final", q).alias(f"p{round(100 * q):02d}") for q in (0.05, 0.5, 0.95)], F.avg((F.col("final") < 0).cast("double")).alias("p_loss"))
