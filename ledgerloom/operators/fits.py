"""Distributions fitted to the values of every key: normal, Student, skew-normal, mixtures of two normals, extreme values.

Fits are iterated aggregations: an iteration joins the parameters of a key to its different values (with their counts), and sums
of weighted moments give the next parameters. Sums combine on the map side, so a key with most of the rows is no hot group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.gammas import log_gamma
from ledgerloom.functions.lineage import cut
from ledgerloom.functions.stats import normal_cdf

HALF_LOG_TAU = 0.5 * math.log(2 * math.pi)
#: Degrees of freedom that Student fits try.
FREEDOMS = (2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 15.0, 20.0, 30.0, 50.0)


def valued(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Key, ``x`` and how often (``c``) the key has it; nulls and values that are no numbers go."""
    good = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf")))
    return cut(good.groupBy(F.col(key).alias("key"), F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c")))


def _log_normal(x: Column, mean: Column, variance: Column) -> Column:
    return -HALF_LOG_TAU - 0.5 * F.log(variance) - (x - mean) * (x - mean) / (2 * variance)


def iterated(values: DataFrame, first: DataFrame, on: list[str], step: Callable[[DataFrame], DataFrame], rounds: int, every: int = 10, most_broadcast: int = 50_000) -> DataFrame:
    """``rounds`` times: parameters joined to their key's values, and aggregated into the next by ``step``. Cut every few rounds.

    Parameters are some dozen bytes a row; up to ``most_broadcast`` rows of them, which are counted, are broadcast, so values stay
    where they are. More are joined by key.
    """
    params = cut(first)
    near = F.broadcast if params.count() <= most_broadcast else lambda df: df
    for k in range(1, rounds + 1):
        params = step(values.join(near(params), on))
        if k % every == 0 and k < rounds:
            params = cut(params)
    return params


def moments(values: DataFrame) -> DataFrame:
    """By key: n, mean, variance (of the population)."""
    n = F.sum("c")
    mean = F.sum(F.col("c") * F.col("x")) / n
    m = values.groupBy("key").agg(n.alias("n"), mean.alias("mean"))
    around = values.join(m, "key").groupBy("key", "n", "mean").agg((F.sum(F.col("c") * F.pow(F.col("x") - F.col("mean"), F.lit(2.0))) / F.col("n")).alias("variance"))
    return around.filter("n >= 2 and variance > 0")


def normal(values: DataFrame) -> DataFrame:
    """By key: model, location, scale, shape (null), log likelihood."""
    m = moments(values)
    ll = -F.col("n") * (HALF_LOG_TAU + 0.5 * F.log("variance") + 0.5)
    return m.select("key", "n", F.lit("normal").alias("model"), F.lit(2).alias("k"), F.col("mean").alias("location"), F.sqrt("variance").alias("scale"), F.lit(None).cast("double").alias("shape"), ll.alias("log_likelihood"))


def student(values: DataFrame, rounds: int = 30, freedoms: tuple[float, ...] = FREEDOMS) -> DataFrame:
    """Student fits by re-weighted moments for each of ``freedoms``, all side by side; the likeliest stays. ``shape`` is the freedom.

    A value counts (v + 1) / (v + z^2), so far ones pull less.
    """
    start = moments(values).select("key", "n", F.explode(F.array(*[F.lit(float(v)) for v in freedoms])).alias("v"), F.col("mean").alias("m"), F.col("variance").alias("s2"))
    x, m, s2, v, c = (F.col(n) for n in ("x", "m", "s2", "v", "c"))
    weight = (v + 1) / (v + (x - m) * (x - m) / s2)

    def step(joined: DataFrame) -> DataFrame:
        w = joined.withColumn("w", weight)
        sums = w.groupBy("key", "n", "v").agg(*[F.sum(c * e).alias(n) for n, e in (("w0", F.col("w")), ("w1", F.col("w") * x), ("w2", F.col("w") * x * x))])
        mean = F.col("w1") / F.col("w0")
        return sums.select("key", "n", "v", mean.alias("m"), ((F.col("w2") - mean * F.col("w1")) / F.col("n")).alias("s2"))

    fitted = iterated(values, start, ["key"], step, rounds)
    each = log_gamma((v + 1) / 2) - log_gamma(v / 2) - 0.5 * F.log(v * math.pi) - 0.5 * F.log(s2) - (v + 1) / 2 * F.log1p((x - m) * (x - m) / (s2 * v))
    rated = values.join(fitted, "key").groupBy("key", "n", "v", "m", "s2").agg(F.sum(c * each).alias("ll"))
    best = rated.groupBy("key", "n").agg(F.max_by(F.struct("v", "m", "s2", "ll"), F.struct(F.round("ll", 6), "v")).alias("b"))
    return best.select("key", "n", F.lit("student").alias("model"), F.lit(3).alias("k"), F.col("b.m").alias("location"), F.sqrt("b.s2").alias("scale"), F.col("b.v").alias("shape"), F.col("b.ll").alias("log_likelihood"))


def _log_cdf(z: Column) -> Column:
    """ln of the normal distribution; its tail by the series of Mills' ratio."""
    far = -z * z / 2 - HALF_LOG_TAU - F.log(F.greatest(-z, F.lit(1.0))) + F.log1p(-1 / (z * z) + 3 / F.pow(z, F.lit(4.0)))
    return F.when(z < -5, far).otherwise(F.log(F.greatest(normal_cdf(z), F.lit(1e-300))))


def skewed(values: DataFrame, rounds: int = 60) -> DataFrame:
    """Skew-normal fits by expectation-maximisation: x = location + d * |half normal| + normal of variance t. ``shape`` is d / sqrt(t),
    ``scale`` sqrt(d^2 + t)."""
    n_, x, c = F.col("n"), F.col("x"), F.col("c")
    cube = values.join(moments(values), "key").groupBy("key", "n", "mean", "variance").agg((F.sum(c * F.pow((x - F.col("mean")) / F.sqrt("variance"), F.lit(3.0))) / n_).alias("skew"))
    lean = F.least(F.greatest(F.col("skew"), F.lit(-0.9)), F.lit(0.9))
    # Where the moments put the asymmetry: delta from the skewness, then location and scale.
    third = F.pow(2 * F.abs(lean) / (4 - math.pi), F.lit(2 / 3))
    delta = F.signum(lean) * F.sqrt(math.pi / 2 * third / (1 + third))
    scale = F.sqrt(F.col("variance") / (1 - 2 * delta * delta / math.pi))
    start = cube.withColumns({"delta": F.when(F.abs(delta) < 0.05, 0.05).otherwise(delta)}).select("key", "n", (F.col("mean") - scale * delta * math.sqrt(2 / math.pi)).alias("at"), (scale * F.col("delta")).alias("d"), (scale * scale * (1 - F.col("delta") * F.col("delta"))).alias("t"))
    at, d, t = F.col("at"), F.col("d"), F.col("t")

    def step(joined: DataFrame) -> DataFrame:
        whole = d * d + t
        e = joined.withColumns({"mu": d * (x - at) / whole, "s": F.sqrt(t / whole)}).withColumn("z", F.col("mu") / F.col("s"))
        e = e.withColumn("h", F.exp(-F.col("z") * F.col("z") / 2 - HALF_LOG_TAU - _log_cdf(F.col("z"))))
        e = e.withColumns({"e1": F.col("mu") + F.col("s") * F.col("h"), "e2": F.col("mu") * F.col("mu") + F.col("s") * F.col("s") + F.col("mu") * F.col("s") * F.col("h")})
        sums = e.groupBy("key", "n", "at", "d").agg(F.sum(c * x).alias("sx"), F.sum(c * x * x).alias("sxx"), F.sum(c * F.col("e1")).alias("s1"), F.sum(c * F.col("e2")).alias("s2"), F.sum(c * x * F.col("e1")).alias("sx1"))
        new_at = (F.col("sx") - d * F.col("s1")) / n_
        new = sums.withColumn("new_at", new_at).withColumn("new_d", (F.col("sx1") - F.col("new_at") * F.col("s1")) / F.col("s2"))
        a, b = F.col("new_at"), F.col("new_d")
        left = F.col("sxx") - 2 * a * F.col("sx") + n_ * a * a - 2 * b * (F.col("sx1") - a * F.col("s1")) + b * b * F.col("s2")
        return new.select("key", "n", a.alias("at"), b.alias("d"), F.greatest(left / n_, F.lit(1e-12)).alias("t"))

    fitted = iterated(values, start, ["key"], step, rounds)
    whole = d * d + t
    each = math.log(2) - HALF_LOG_TAU - 0.5 * F.log(whole) - (x - at) * (x - at) / (2 * whole) + _log_cdf(d / F.sqrt(t) * (x - at) / F.sqrt(whole))
    return values.join(fitted, "key").groupBy("key", "n", "at", "d", "t").agg(F.sum(c * each).alias("ll")).select("key", "n", F.lit("skewed").alias("model"), F.lit(3).alias("k"), at.alias("location"), F.sqrt(whole).alias("scale"), (d / F.sqrt(t)).alias("shape"), F.col("ll").alias("log_likelihood"))


def mixtures(values: DataFrame, rounds: int = 20) -> DataFrame:
    """Two normals each, from a sigma below and above the mean, by expectation-maximisation of ``rounds`` steps: weight (of the first),
    m1, v1, m2, v2 and log likelihood."""
    x, c = F.col("x"), F.col("c")
    sigma = F.sqrt("variance")
    start = moments(values).select("key", "n", "variance", F.lit(0.5).alias("w"), (F.col("mean") - sigma).alias("m1"), F.col("variance").alias("v1"), (F.col("mean") + sigma).alias("m2"), F.col("variance").alias("v2"))
    one = F.log("w") + _log_normal(x, F.col("m1"), F.col("v1"))
    two = F.log(1 - F.col("w")) + _log_normal(x, F.col("m2"), F.col("v2"))
    share = 1 / (1 + F.exp(F.least(F.greatest(two - one, F.lit(-700.0)), F.lit(700.0))))

    def step(joined: DataFrame) -> DataFrame:
        r = joined.withColumn("r", share)
        sums = r.groupBy("key", "n", "variance").agg(*[F.sum(c * e).alias(n) for n, e in (("r0", F.col("r")), ("r1", F.col("r") * x), ("r2", F.col("r") * x * x), ("q0", 1 - F.col("r")), ("q1", (1 - F.col("r")) * x), ("q2", (1 - F.col("r")) * x * x))])
        m1, m2 = F.col("r1") / F.col("r0"), F.col("q1") / F.col("q0")
        # A variance below a millionth of the whole would be a spike on one value.
        least = F.col("variance") * 1e-6
        w = F.least(F.greatest(F.col("r0") / F.col("n"), F.lit(1e-9)), F.lit(1 - 1e-9))
        return sums.select("key", "n", "variance", w.alias("w"), m1.alias("m1"), F.greatest(F.col("r2") / F.col("r0") - m1 * m1, least).alias("v1"), m2.alias("m2"), F.greatest(F.col("q2") / F.col("q0") - m2 * m2, least).alias("v2"))

    fitted = iterated(values, start, ["key"], step, rounds)
    top = F.greatest(one, two)
    each = top + F.log(F.exp(one - top) + F.exp(two - top))
    columns = ["key", "n", "w", "m1", "v1", "m2", "v2"]
    return values.join(fitted, "key").groupBy(*columns).agg(F.sum(c * each).alias("log_likelihood"))


def best_fits(values: DataFrame) -> DataFrame:
    """All three fits of every key, with AIC; ``best`` marks the smallest (ties to the simpler, then by name)."""
    fits = normal(values).unionByName(student(values)).unionByName(skewed(values)).withColumn("aic", 2 * F.col("k") - 2 * F.col("log_likelihood"))
    order = Window.partitionBy("key").orderBy(F.round("aic", 6), "k", "model")
    return fits.withColumn("best", F.row_number().over(order) == 1)


def block_maxima(trades: DataFrame, key: str, size: int, *, least: int = 10, levels: tuple[float, ...] = (0.999, 0.9995, 0.9999)) -> DataFrame:
    """Generalised extreme value fits of the largest loss of every block of ``size`` trades in order, by L-moments: blocks, location,
    scale, shape (positive: bounded above), worst loss, and the loss that a share of ``levels`` of blocks stays under.

    Only whole blocks count. Trades are numbered by a scan over days; the order statistics are windows over maxima, of which there
    are ``size`` times fewer than trades. Keys with under ``least`` blocks are left out.
    """
    from .scans import running
    from .series import BY_TRADE

    run = running(trades, [key], BY_TRADE, F.to_date("entry_time"), {"nth": F.lit(1).cast("long")})
    maxima = run.groupBy(key, F.floor((F.col("nth") - 1) / size).alias("block")).agg(F.max(-F.col("profit_loss")).alias("loss"), F.count("*").alias("trades")).filter(F.col("trades") == size)
    ranked = maxima.withColumn("j", (F.row_number().over(Window.partitionBy(key).orderBy("loss", "block")) - 1).cast("double"))
    n = ranked.groupBy(key).agg(F.count("*").cast("double").alias("n")).filter(F.col("n") >= least)
    j, m, x = F.col("j"), F.col("n"), F.col("loss")
    b = ranked.join(n, key).groupBy(key, "n").agg(F.avg(x).alias("b0"), (F.sum(x * j) / (m * (m - 1))).alias("b1"), (F.sum(x * j * (j - 1)) / (m * (m - 1) * (m - 2))).alias("b2"), F.max(x).alias("worst"))
    l2, l3 = 2 * F.col("b1") - F.col("b0"), 6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")
    c = 2 / (3 + F.col("l3") / F.col("l2")) - math.log(2) / math.log(3)
    fit = b.withColumns({"l2": l2, "l3": l3}).filter("l2 > 0").withColumn("shape", 7.8590 * c + 2.9554 * c * c)
    k = F.col("shape")
    fit = fit.filter(F.abs(k) > 1e-9).withColumn("g", F.exp(log_gamma(1 + k)))
    fit = fit.withColumn("scale", F.col("l2") * k / ((1 - F.pow(F.lit(2.0), -k)) * F.col("g"))).withColumn("location", F.col("b0") - F.col("scale") * (1 - F.col("g")) / k)
    beyond = {f"level_{str(p)[2:]}": F.col("location") + F.col("scale") / k * (1 - F.pow(F.lit(-math.log(p)), k)) for p in levels}
    return fit.select(key, F.col("n").cast("long").alias("blocks"), "location", "scale", "shape", "worst", *[e.alias(name) for name, e in beyond.items()])
