"""Trades against a market series: as-of joins, fills of gaps, correlation, beta."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_close(trades: DataFrame, market: DataFrame, days_back: int = 3) -> DataFrame:
    """The last close on or up to ``days_back`` days before the entry: every close is laid over the days it can serve, so the
    join is on equality."""
    served = market.select(F.col("date").alias("market_date"), "close", F.explode(F.sequence("date", F.date_add("date", days_back))).alias("date"))
    latest = served.groupBy("date").agg(F.max_by("close", "market_date").alias("close"), F.max("market_date").alias("market_date"))
    return trades.withColumn("date", F.to_date("entry_time")).join(latest, "date", "left")


def filled_close(trades: DataFrame, market: DataFrame, *keys: str) -> DataFrame:
    """The close of the entry's day; where it is missing, that of the trade before."""
    w = Window.partitionBy(*keys).orderBy("entry_time", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = trades.withColumn("date", F.to_date("entry_time")).join(market.withColumnRenamed("close", "exact"), "date", "left")
    return joined.withColumn("close", F.last("exact", ignorenulls=True).over(w))


def daily(trades: DataFrame) -> DataFrame:
    return trades.groupBy("account_name", F.to_date("entry_time").alias("date")).agg(F.sum("profit_loss").alias("pnl"))


def account_correlations(trades: DataFrame, min_days: int = 5) -> DataFrame:
    """Correlation of daily profits of every two accounts with enough days in common. The days are aggregated before the join."""
    d = daily(trades)
    a, b = d.select("date", F.col("account_name").alias("a"), F.col("pnl").alias("x")), d.select("date", F.col("account_name").alias("b"), F.col("pnl").alias("y"))
    return a.join(b, "date").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("days"), F.corr("x", "y").alias("correlation")).filter(F.col("days") >= min_days)


def returns(market: DataFrame) -> DataFrame:
    """Change in percent against the row before. A daily index is one short series."""
    before = F.lag("close").over(Window.partitionBy(F.lit(1)).orderBy("date"))
    return market.withColumn("ret", (F.col("close") / before - 1) * 100).filter("ret is not null")


def beta(trades: DataFrame, market: DataFrame) -> DataFrame:
    """Slope, intercept and fit of daily profit on market returns, by account."""
    j = daily(trades).join(returns(market), "date")
    slope = F.regr_slope("pnl", "ret")
    return j.groupBy("account_name").agg(F.count("*").alias("days"), slope.alias("beta"), F.regr_intercept("pnl", "ret").alias("alpha"), F.regr_r2("pnl", "ret").alias("r2"))


def ratios(trades: DataFrame, market: DataFrame, rate: float = 0.02) -> DataFrame:
    """By account, of daily profit against market returns: alpha a day and a year over what beta explains, the year's tracking error of
    what it does not, their ratio, and the year's excess profit for each unit of beta (Treynor). ``rate`` is the riskless yearly return.

    All follow from means, variances and one covariance, which combine on the map side.
    """
    free = rate / 252
    g = daily(trades).join(returns(market), "date").groupBy("account_name").agg(
        F.count("*").alias("days"), F.avg("pnl").alias("p"), F.avg("ret").alias("m"), F.var_pop("pnl").alias("vp"), F.var_pop("ret").alias("vm"), F.covar_pop("pnl", "ret").alias("c")
    )
    g = g.filter("vm > 0").withColumn("beta", F.col("c") / F.col("vm"))
    alpha = F.col("p") - free - F.col("beta") * (F.col("m") - free)
    error = F.sqrt(F.greatest(F.col("vp") - F.col("beta") * F.col("c"), F.lit(0.0))) * F.sqrt(F.lit(252.0))
    out = g.withColumns({"alpha_daily": alpha, "alpha_annual": alpha * 252, "tracking_error": error})
    return out.select("account_name", "days", "beta", "alpha_daily", "alpha_annual", "tracking_error", (F.col("alpha_annual") / F.nullif("tracking_error", F.lit(0.0))).alias("information_ratio"), ((F.col("p") * 252 - rate) / F.nullif("beta", F.lit(0.0))).alias("treynor"))


def diversification(correlations: DataFrame) -> DataFrame:
    """One row: pairs, their mean correlation, the score 1 - mean (0 at least), the strongest and the weakest pair by absolute value,
    and pairs above 0.7. Takes the result of :func:`account_correlations`; pairs without a correlation count as 0."""
    c = correlations.withColumn("r", F.coalesce("correlation", F.lit(0.0)))
    size = F.struct(F.round(F.abs("r"), 9).alias("size"), F.concat_ws("/", "a", "b").alias("pair"))
    return c.agg(
        F.count("*").alias("pairs"), F.avg("r").alias("mean_correlation"), F.greatest(F.lit(0.0), 1 - F.avg("r")).alias("score"), F.max(size)["pair"].alias("strongest"), F.min(size)["pair"].alias("weakest"), F.count_if(F.col("r") > 0.7).alias("warnings")
    )


def regime_performance(trades: DataFrame, market: DataFrame, low: float = 15.0, high: float = 25.0) -> DataFrame:
    """By regime of the as-of close: trades, profit, win rate, sharpe times the root of 252."""
    j = asof_close(trades, market).filter("close is not null")
    regime = F.when(F.col("close") < low, "Low").when(F.col("close") <= high, "Medium").otherwise("High")
    p = F.col("profit_loss")
    return j.groupBy("account_name", regime.alias("regime")).agg(
        F.count("*").alias("n"), F.sum(p).alias("total"), (F.count_if(p > 0) / F.count("*")).alias("win_rate"), (F.avg(p) / F.nullif(F.stddev_samp(p), F.lit(0.0)) * F.sqrt(F.lit(252.0))).alias("sharpe")
    )


def band_matches(left: DataFrame, right: DataFrame, seconds: int = 90, price: float = 2.0) -> DataFrame:
    """Best partner of each left row within a band of time and price: the nearest in time, then in price, then the first by id.

    Rows meet in cells of eight bands of time and four of price; a right row goes to its own and to those that its band reaches
    into, so there are under two of it. The rows of a cell come sorted, and pairs are looked at where they lie, a bounded number
    at once: no pair is sorted or sent, only the best of each left row. A task holds one cell's rows.
    """
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    wide, high = max(8 * seconds, 1), 4 * max(price, 1e-9)
    cell, reach = F.floor(F.col("price") / high), 0.26  # a quarter, and some more for the rounding
    own = left.select("account", F.floor(sec / wide).alias("b"), cell.alias("c"), F.lit(False).alias("right"), sec.alias("t"), F.col("price").cast("double").alias("p"), F.col("fill_id").alias("id"))
    near = right.withColumn("b", F.explode(F.sequence(F.floor((sec - seconds) / wide), F.floor((sec + seconds) / wide))))
    near = near.withColumn("c", F.explode(F.sequence(F.floor(F.col("price") / high - reach), F.floor(F.col("price") / high + reach))))
    near = near.select("account", "b", "c", F.lit(True).alias("right"), sec.alias("t"), F.col("price").cast("double").alias("p"), F.col("fill_id").alias("id"))
    dealt = own.unionByName(near).dropna(subset=["account", "b", "c"]).repartition("account", "b", "c").sortWithinPartitions("account", "b", "c", "t")
    kind = dict(dealt.dtypes)["id"]
    met = dealt.mapInArrow(lambda batches: _best_by_cell(batches, seconds, price), f"fill_id {kind}, r_id {kind}, gap long, d double, candidates long")
    best = met.groupBy("fill_id").agg(F.min(F.struct("gap", "d", "r_id")).alias("m"), F.sum("candidates").alias("candidates"))
    return best.select("fill_id", "m.r_id", "m.gap", "candidates")


def _changes(t: pa.Table) -> np.ndarray:
    """Whether a row is of another cell than the row before it (not told of the first)."""
    away = np.zeros(max(len(t) - 1, 0), dtype=bool)
    for c in ("account", "b", "c"):
        away |= pc.not_equal(t[c].slice(1), t[c].slice(0, len(t) - 1)).to_numpy()
    return away


def _best_by_cell(batches: Iterator[pa.RecordBatch], seconds: int, price: float) -> Iterator[pa.RecordBatch]:
    """Whole cells of the sorted rows, as many at once as a batch ends; the last one waits for the next batch."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        ends = np.flatnonzero(_changes(t)) + 1
        last = int(ends[-1]) if len(ends) else 0
        same = held and not _changes(pa.concat_tables([held[-1].slice(len(held[-1]) - 1), t.slice(0, 1)])).any()
        if last or not same:
            whole = [*held, t.slice(0, last)]
            if held or last:
                yield from _best_in_bands(pa.concat_tables(whole), seconds, price)
            held = []
        held.append(t.slice(last))
    if held:
        yield from _best_in_bands(pa.concat_tables(held), seconds, price)


def _best_in_bands(t: pa.Table, seconds: int, price: float, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The best partner of every left row of some cells, and how many it has; about ``most`` pairs are looked at in one go."""
    t = t.combine_chunks()
    number = np.concatenate([[0], np.cumsum(_changes(t))])
    right, at, p = t["right"].to_numpy(), t["t"].to_numpy(), t["p"].to_numpy()
    l, r = np.flatnonzero(~right), np.flatnonzero(right)  # noqa: E741
    if not len(l) or not len(r):
        return
    # Cells are laid one after another on one axis, further apart than a band.
    begin = at - at.min()
    axis = number * (int(begin.max()) + 2 * seconds + 2) + begin
    low, high = np.searchsorted(axis[r], axis[l] - seconds, "left"), np.searchsorted(axis[r], axis[l] + seconds, "right")
    place = np.empty(len(t), dtype=np.int64)  # order of the ids, which decides last
    place[pc.sort_indices(t["id"]).to_numpy()] = np.arange(len(t))
    before = np.concatenate([[0], np.cumsum(high - low)])
    a = 0
    while a < len(l):
        z = max(a + 1, int(np.searchsorted(before, before[a] + most, "right")) - 1)
        sizes = (high - low)[a:z]
        owner = np.repeat(np.arange(a, z), sizes)
        other = r[np.arange(len(owner)) - np.repeat(before[a:z] - before[a], sizes) + np.repeat(low[a:z], sizes)]
        d = np.abs(p[l[owner]] - p[other])
        ok = d <= price
        owner, other, d = owner[ok], other[ok], d[ok]
        gap = np.abs(at[l[owner]] - at[other])
        if len(owner):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            counts = np.diff(np.append(starts, len(owner)))
            tied = np.flatnonzero(gap == np.repeat(np.minimum.reduceat(gap, starts), counts))
            tied = tied[np.lexsort((place[other[tied]], d[tied], owner[tied]))]
            tied = tied[np.concatenate([[True], owner[tied][1:] != owner[tied][:-1]])]
            ids = lambda rows: t["id"].take(pa.array(rows)).combine_chunks()
            yield from pa.table({"fill_id": ids(l[owner[tied]]), "r_id": ids(other[tied]), "gap": gap[tied], "d": d[tied], "candidates": counts.astype(np.int64)}).to_batches()
        a = z
