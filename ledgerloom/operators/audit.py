"""One-to-one matching of two lists of trades or fills within bands of time and price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.lineage import cut


def _cells(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def candidates(left: DataFrame, right: DataFrame, keys: list[str], seconds: int = 90, price: float = 2.0, bands: tuple[tuple[str, str], ...] = (("ts", "price"),)) -> DataFrame:
    """Pairs ``l_id``, ``r_id`` of rows with equal keys whose times differ by at most ``seconds`` and prices by at most ``price``, for every
    (time, price) of ``bands`` (a trade has two: entry and exit); ``gap`` is the sum of the time differences, ``apart`` of the prices'.

    Rows meet on keys and cells of the first band's time and price, each right row in the nine cells around its own, so a busy
    hour does not meet itself but where prices are near, too. Both need an ``id``; rows with nulls match nothing.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    (t0, p0), width = bands[0], max(price, 1e-9)
    columns = [c for band in bands for c in band]
    side = lambda df, p: df.select(*[F.col(k).alias(f"{p}{k}") for k in keys], F.col("id").alias(f"{p}id"), *[(at(c) if c in [t for t, _ in bands] else F.col(c).cast("double")).alias(f"{p}{c}") for c in columns])
    l = side(left, "l_").withColumns({"tc": _cells(F.col(f"l_{t0}"), seconds), "pc": _cells(F.col(f"l_{p0}"), width)})  # noqa: E741
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    r = side(right, "r_").select("*", F.explode(F.transform(near, lambda i: _cells(F.col(f"r_{t0}"), seconds) + i)).alias("tc")).select("*", F.explode(F.transform(near, lambda i: _cells(F.col(f"r_{p0}"), width) + i)).alias("pc"))
    same = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys]
    met = l.withColumnsRenamed({"tc": "l_tc", "pc": "l_pc"}).join(r, [*same, F.col("l_tc") == F.col("tc"), F.col("l_pc") == F.col("pc")])
    gaps = [F.abs(F.col(f"l_{t}") - F.col(f"r_{t}")) for t, _ in bands]
    apart = [F.abs(F.col(f"l_{p}") - F.col(f"r_{p}")) for _, p in bands]
    held = met
    for g, a in zip(gaps, apart, strict=True):
        held = held.filter((g <= seconds) & (a <= price))
    add = lambda xs: sum(xs[1:], xs[0])
    return held.select("l_id", "r_id", add(gaps).alias("gap"), add(apart).alias("apart"))


def one_to_one(pairs: DataFrame, rounds: int = 1000) -> DataFrame:
    """The greedy matching of candidate pairs: the nearest pair (by gap, then apart, then ids) is taken, both rows are used up, and
    so on until no pair is left.

    A pair that is the best of both its rows is taken by the greedy walk whatever else happens, so all such pairs are taken at
    once, the pairs of used rows go, and the next round begins. Every round takes the nearest pair left at least; a few rounds do
    unless gaps fall along a long chain, and more than ``rounds`` is an error, never a shorter result. Each round is cut off by
    a checkpoint.
    """
    rank = F.struct("gap", "apart", "l_id", "r_id")
    left, taken = cut(pairs.select("l_id", "r_id", "gap", "apart", rank.alias("rank"))), None
    for _ in range(rounds):
        best = left.withColumns({"l_best": F.min("rank").over(Window.partitionBy("l_id")), "r_best": F.min("rank").over(Window.partitionBy("r_id"))})
        now = cut(best.withColumn("mutual", (F.col("rank") == F.col("l_best")) & (F.col("rank") == F.col("r_best"))).drop("l_best", "r_best"))
        chosen = now.filter("mutual").drop("mutual")
        taken = chosen if taken is None else taken.unionByName(chosen)
        rest = now.filter("not mutual").drop("mutual")
        left = cut(rest.join(chosen.select("l_id"), "l_id", "left_anti").join(chosen.select("r_id"), "r_id", "left_anti"))
        if left.isEmpty():
            return taken.drop("rank")
    raise RuntimeError(f"pairs are left after {rounds} rounds")


def matched(left: DataFrame, right: DataFrame, keys: list[str], seconds: int = 90, price: float = 2.0, bands: tuple[tuple[str, str], ...] = (("ts", "price"),), most: float = 8.0) -> DataFrame:
    """``one_to_one(candidates(...))`` without all candidate pairs at once: their number grows with the square of how dense rows lie.

    The greedy walk goes by gap, so it can be cut anywhere: pairs within a small gap are matched to the end, and only rows that are
    left meet within a larger one. Those of both sides that are left have no partner within the gap before, so there are few pairs
    again. A step is the largest gap (the band over a power of four) at which about ``most`` pairs a row or fewer are to be
    expected, by counts of rows in cells of time; it decides about the size of steps only, never about a pair.
    """
    widest, done, taken, t0 = float(seconds * len(bands)), 0.0, None, bands[0][0]
    steps = [widest / 4**k for k in range(13)]
    counted = lambda df, n, w: df.groupBy(*keys, _cells(F.unix_micros(F.col(t0).cast("timestamp")) / 1e6, w).alias("cell")).agg(F.count("*").alias(n))
    while done < widest:
        larger = [w for w in steps if w > done]
        for gap in larger:
            if gap == larger[-1]:
                break
            met = counted(left, "n_l", gap).join(counted(right, "n_r", gap), [*keys, "cell"], "full")
            pairs, rows = met.agg(F.sum(2.0 * F.col("n_l") * F.col("n_r")), F.sum(F.coalesce("n_l", F.lit(0)) + F.coalesce("n_r", F.lit(0)))).first()
            if (pairs or 0.0) <= most * (rows or 0):
                break
        near = candidates(left, right, keys, min(gap, seconds), price, bands)
        now = one_to_one(near if gap == widest else near.filter(F.col("gap") <= gap))
        taken, done = now if taken is None else taken.unionByName(now), gap
        if done < widest:
            rest = lambda df, own: cut(df.join(now.select(F.col(own).alias("id")), "id", "left_anti"))  # noqa: B023, E731
            left, right = rest(left, "l_id"), rest(right, "r_id")
    return taken


def audit(left: DataFrame, right: DataFrame, matched: DataFrame) -> DataFrame:
    """Every row of both sides: ``side``, ``id``, and the partner's ``match`` or null."""
    one = lambda df, side, own, other: df.select(F.lit(side).alias("side"), "id").join(matched.select(F.col(own).alias("id"), F.col(other).alias("match")), "id", "left")
    return one(left, "left", "l_id", "r_id").unionByName(one(right, "right", "r_id", "l_id"))
