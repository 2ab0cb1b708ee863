"""Resampling in one pass: bootstrap intervals of any statistic, and label permutations within accounts.

Neither sends a row around for a resample. A row's weight or place in a resample is a digest of the row and the resample's number,
taken where the row lies, and the sums of a resample combine on the map side.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.lineage import cut
from ledgerloom.functions.stats import binomial_p_value

from .scans import count_below, running
from .series import adjusted_p
from .simulate import hashed

#: A Poisson variable of mean 1 is at least k + 1 where a uniform one passes these; the rest is below 1e-13.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(16))


def poisson_weight(u: Column) -> Column:
    """How often a row is drawn: Poisson with mean 1, from a uniform draw."""
    out = F.lit(0)
    for p in POISSON:
        out = out + (u >= p).cast("int")
    return out


def weighted(rows: DataFrame, row_id: str, sims: int, seed: int) -> DataFrame:
    """Every row in every resample (``sim``) with its Poisson weight ``_w``, that of :func:`poisson_weight` of the uniform draw.

    The draw is (h + 0.5) / 2^32 with h the first 8 digits of a digest in hexadecimal, and such digits sort as their numbers do. So
    the bounds are written as digits, and a digest is compared with one or two of them, without becoming a number.
    """
    bounds = []
    for p in POISSON:
        h = max(math.ceil(p * (1 << 32)) - 2, 0)
        while (h + 0.5) / float(1 << 32) < p:
            h += 1
        if h < 1 << 32:
            bounds.append(f"{h:08x}")
    weight = F.lit(float(len(bounds)))
    for k in reversed(range(len(bounds))):
        weight = F.when(F.col("_digest") < bounds[k], float(k)).otherwise(weight)
    laid = rows.withColumn("_of", F.concat_ws("-", F.lit(seed).cast("string"), F.col(row_id).cast("string"), F.lit("")))
    laid = laid.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    return laid.withColumn("_digest", F.md5(F.concat("_of", F.col("sim").cast("string")))).withColumn("_w", weight).drop("_of", "_digest")


def bootstrap(rows: DataFrame, keys: list[str], row_id: str, statistic: Callable[[Column], Column], sims: int = 200, seed: int = 42) -> DataFrame:
    """``statistic`` of every resample: keys, ``sim``, ``value``.

    ``statistic`` takes a column of weights and returns an aggregate over the rows of a key, such as
    ``lambda w: F.sum(w * x) / F.sum(w)``; any expression of weighted sums will do. A row counts a Poisson number of times, which is
    the bootstrap of many rows without knowing how many there are.
    """
    laid = weighted(rows, row_id, sims, seed)
    return laid.groupBy(*keys, "sim").agg(statistic(F.col("_w")).alias("value"))


def intervals(rows: DataFrame, keys: list[str], row_id: str, statistics: dict[str, Callable[[Column], Column]], sims: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """By key and named statistic: its value, the bounds of the percentile interval, and the standard error of the resamples.

    All statistics of a resample come from one pass over the rows.
    """
    laid = weighted(rows, row_id, sims, seed)
    resampled = laid.groupBy(*keys, "sim").agg(*[s(F.col("_w")).alias(n) for n, s in statistics.items()])
    observed = rows.withColumn("_w", F.lit(1.0)).groupBy(*keys).agg(*[s(F.col("_w")).alias(n) for n, s in statistics.items()])
    long = lambda df, *extra: df.select(*keys, *extra, F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value")) for n in statistics])).alias("x")).select(*keys, *extra, "x.*")
    tail = (1 - level) / 2
    bounds = long(resampled, "sim").groupBy(*keys, "statistic").agg(F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"), F.stddev_samp("value").alias("error"))
    return long(observed).join(bounds, [*keys, "statistic"])


@lru_cache
def large_primes(count: int = 64, below: int = 1 << 31) -> tuple[int, ...]:
    """The largest primes under ``below``, by trial division."""
    found, n = [], below - 1
    while len(found) < count:
        if all(n % d for d in range(3, math.isqrt(n) + 1, 2)):
            found.append(n)
        n -= 2
    return tuple(found)


def permuted_place(place: Column, size: Column, seed: int, perm: Column, stratum: Column) -> Column:
    """Where a permutation of 0 .. size - 1 puts ``place``: (a * place + b) modulo the size, with a and b from digests.

    ``a`` is a product of two primes above any size (under 2^31), so it has no divisor in common with the size, and the map is
    one to one. Places should be numbered in an order that has nothing to do with the values (:func:`shuffled`).
    """
    a, b = permutation(size, seed, perm, stratum)
    return (a * place + b) % size


def permutation(size: Column, seed: int, perm: Column, stratum: Column) -> tuple[Column, Column]:
    """The a and b of :func:`permuted_place`, which hang on the stratum and the permutation alone."""
    primes = F.array(*[F.lit(p) for p in large_primes()])
    pick = lambda name: F.get(primes, (hashed(F.lit(seed), stratum, perm, F.lit(name)) % len(large_primes())).cast("int")) % size
    return (pick("p") * pick("q")) % size, hashed(F.lit(seed), stratum, perm, F.lit("b")) % size


def shuffled(rows: DataFrame, stratum: str, row_id: str, seed: int) -> DataFrame:
    """Adds ``place`` (:func:`places`) and ``size``, that of the stratum."""
    return places(rows, stratum, row_id, seed).join(rows.groupBy(stratum).agg(F.count("*").alias("size")), stratum)


def places(rows: DataFrame, stratum: str, row_id: str, seed: int) -> DataFrame:
    """Adds ``place``, the row's number within its stratum in the order of a digest. Digests are cut into ranges, which are numbered
    by themselves and moved by the counts of those before, so a stratum is as many tasks as it has ranges."""
    digest = rows.withColumn("_h", hashed(F.lit(seed), F.col(row_id)))
    numbered = running(digest, [stratum], ["_h", row_id], F.floor(F.col("_h") / (1 << 24)), {"_n": F.lit(1).cast("long")})
    return numbered.withColumn("place", F.col("_n") - 1).drop("_h", "_n")


def selected_by_luck(trades: DataFrame, stratum: str, cell: list[str], *, perms: int = 1000, min_trades: int = 30, rate: float = 0.05, seed: int = 42, most_cells: int = 4096) -> DataFrame:
    """What selecting significant cells finds when profits are dealt anew among the trades of an account: ``perm`` (-1: as they are),
    cells selected, their trades and profit.

    In every permutation a trade's profit goes to another place of its account. Cells own consecutive places, as many as they
    have trades, so the cell of a place is found in the account's list of cell starts (at most ``most_cells``, checked), without a
    join; profits and wins of cells add up on the map side, and the cells of an account are tested as real ones are: one-sided
    binomial p of the win rate, adjusted within the account, mean above zero.
    """
    p = F.col("profit_loss")
    sizes = trades.groupBy(stratum, *cell).agg(F.count("*").alias("n"), F.sum(p).alias("pnl"), F.count_if(p > 0).alias("wins"))
    w = Window.partitionBy(stratum).orderBy(*cell)
    starts = sizes.withColumn("start", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("number", F.row_number().over(w) - 1)
    listed = cut(starts.groupBy(stratum).agg(F.array_sort(F.collect_list("start")).alias("starts"), F.sum("n").alias("size")))
    most, strata = listed.agg(F.coalesce(F.max(F.size("starts")), F.lit(0)), F.count("*")).first()
    if most > most_cells:
        raise ValueError(f"an account has more than {most_cells} cells")
    # A permutation of an account is two numbers, made once and not for each of its trades.
    a, b = permutation(F.col("size"), seed, F.col("perm"), F.col(stratum))
    dealt = cut(listed.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1)))).withColumns({"a": a, "b": b}))
    rows = places(trades.select(stratum, "trade_id", "profit_loss"), stratum, "trade_id", seed)
    laid = rows.join(F.broadcast(dealt) if strata * perms <= 50_000 else dealt, stratum)
    laid = laid.withColumn("to", (F.col("a") * F.col("place") + F.col("b")) % F.col("size"))
    laid = count_below(laid, "after", "starts", F.col("to"), most, equal=True).withColumn("number", F.col("after") - 1)
    drawn = laid.groupBy(stratum, "perm", "number").agg(F.count("*").alias("n"), F.sum(p).alias("pnl"), F.count_if(p > 0).alias("wins"))
    real = starts.select(stratum, F.lit(-1).alias("perm"), "number", "n", "pnl", "wins")
    tested = drawn.unionByName(real).filter(F.col("n") >= min_trades).withColumn("p", binomial_p_value(F.col("wins"), F.col("n"))).withColumn("id", F.col("number"))
    q = adjusted_p(tested, [stratum, "perm"])
    good = q.filter((F.col("q") <= rate) & (2 * F.col("wins") >= F.col("n")) & (F.col("pnl") > 0)).groupBy("perm").agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum("pnl").alias("total"))
    every = trades.sparkSession.range(-1, perms).select(F.col("id").cast("int").alias("perm"))
    return every.join(good, "perm", "left").select("perm", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cells", "n")], F.coalesce("total", F.lit(0.0)).alias("total"))


def luck_test(found: DataFrame) -> DataFrame:
    """The real selection against the permuted: cells, profit, means of the permutations, and the share that does as well or better."""
    real = found.filter("perm = -1").select(F.col("cells").alias("cells"), F.col("total").alias("total"))
    luck = found.filter("perm >= 0").crossJoin(F.broadcast(real.toDF("real_cells", "real_total")))
    return luck.groupBy(F.col("real_cells").alias("cells"), F.col("real_total").alias("total")).agg(
        F.count("*").alias("perms"), F.avg("cells").alias("mean_cells"), F.avg("total").alias("mean_total"), F.avg((F.col("cells") >= F.col("real_cells")).cast("double")).alias("p_cells"), F.avg((F.col("total") >= F.col("real_total")).cast("double")).alias("p_total")
    )
