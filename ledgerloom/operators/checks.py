"""Checks of trades: rules as columns, counted in one pass; what fails is listed, not dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def import_rules(most_profit: float = 10_000.0, hours: tuple[int, int] = (6, 22)) -> dict[str, Column]:
    """Rules that a trade breaks, by name."""
    entry = F.col("entry_time")
    return {
        "large_result": F.abs("profit_loss") > most_profit,
        "no_duration": _seconds("exit_time") <= _seconds("entry_time"),
        "over_a_day": _seconds("exit_time") - _seconds("entry_time") > 86_400,
        "odd_hour": ~F.hour(entry).between(*hours),
        "weekend": F.weekday(entry) >= 5,
        "no_quantity": F.coalesce(F.col("quantity"), F.lit(0)) <= 0,
    }


def broken(trades: DataFrame, rules: dict[str, Column], by: str | None = None) -> DataFrame:
    """Rows (by, rule, n, share) for every rule, broken or not, and severity: OK, WARNING below 5 percent, ERROR from there."""
    keys = [by] if by else []
    counted = trades.groupBy(*keys).agg(F.count("*").alias("all"), *[F.count_if(F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    long = counted.unpivot([*keys, "all"], list(rules), "rule", "n")
    share = F.col("n") / F.nullif(F.col("all"), F.lit(0))
    return long.select(*keys, "rule", "n", share.alias("share"), F.when(F.col("n") == 0, "OK").when(share < 0.05, "WARNING").otherwise("ERROR").alias("severity"))


def validated(trades: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Every trade with the names of the rules it breaks."""
    return trades.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()])))


def field_rules(sides: tuple[str, ...] = ("LONG", "SHORT"), most_quantity: int = 50) -> dict[str, Column]:
    """Required fields, enumerations and ranges."""
    required = {f"missing_{c}": F.col(c).isNull() for c in ("account_name", "symbol", "entry_time", "profit_loss")}
    return required | {"side": ~F.coalesce(F.col("side").isin(*sides), F.lit(False)), "quantity": ~F.coalesce(F.col("quantity").between(1, most_quantity), F.lit(False)), "order_of_times": F.col("exit_time") < F.col("entry_time")}


def pruned(trades: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """Every trade with why it goes (null: stays): over several days, negative duration, or a repeat of an earlier one.

    Of equal trades (``key``) the one with the least id stays, found by an aggregation and not a window.
    """
    first = trades.groupBy(*key).agg(F.min(id_col).alias("_first"))
    joined = trades.join(first, key)
    reason = F.when(F.to_date("entry_time") < F.to_date("exit_time"), "multi_day").when(F.col("exit_time") < F.col("entry_time"), "negative").when(F.col(id_col) > F.col("_first"), "repeat")
    return joined.withColumn("reason", reason).drop("_first")


def catalogue(trades: DataFrame, key: str = "symbol") -> DataFrame:
    """What there is of every symbol: trades, accounts, first and last entry."""
    return trades.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("account_name").alias("accounts"), F.min("entry_time").alias("first_entry"), F.max("entry_time").alias("last_entry"))


def dataset_stats(trades: DataFrame) -> DataFrame:
    return trades.agg(F.count("*").alias("n"), F.count_distinct("account_name").alias("accounts"), F.count_distinct("symbol").alias("symbols"), F.min("entry_time").alias("first_entry"), F.max("entry_time").alias("last_entry"), F.sum("profit_loss").alias("total"))


def compared(sample: DataFrame, known: DataFrame, key: str, *, money: float = 0.01, seconds: float = 5.0) -> DataFrame:
    """Every sampled trade against the known one: exact, close (within both tolerances), different, or missing."""
    k = known.select(key, F.col("profit_loss").alias("_p"), _seconds("entry_time").alias("_t"), F.lit(True).alias("_there"))
    j = sample.join(k, key, "left")
    dp, dt = F.abs(F.col("profit_loss") - F.col("_p")), F.abs(_seconds("entry_time") - F.col("_t"))
    verdict = F.when(F.col("_there").isNull(), "missing").when((dp == 0) & (dt == 0), "exact").when((dp <= money) & (dt <= seconds), "close").otherwise("different")
    return j.withColumn("verdict", verdict).drop("_p", "_t", "_there")


def latest_before(events: DataFrame, trained: DataFrame, key: str, date_col: str, trained_col: str) -> DataFrame:
    """Every event with the latest training date up to its own, and the days between (model age).

    Both are put in one series by key and date, and the last training date is carried forward.
    """
    from pyspark.sql import Window

    both = events.select(key, F.col(date_col).alias("date"), F.lit(1).alias("kind")).unionByName(trained.select(key, F.col(trained_col).alias("date"), F.lit(0).alias("kind")))
    w = Window.partitionBy(key).orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("trained", F.last(F.when(F.col("kind") == 0, F.col("date")), ignorenulls=True).over(w))
    return seen.filter("kind = 1").select(key, "date", "trained", F.datediff("date", "trained").alias("age"))


def gated(recommended: DataFrame, results: DataFrame, key: list[str], created: str) -> DataFrame:
    """Recommendations whose latest walk-forward result passes: sharpe above zero, and a worst drop over three mean losses or 500."""
    order = F.struct(created, "result_id")
    last = results.groupBy(*key).agg(F.max_by("sharpe", order).alias("oos_sharpe"), F.max_by("max_drop", order).alias("oos_drop"))
    limit = F.greatest(3 * F.abs("mean"), F.lit(500.0))
    j = recommended.join(last, key, "left")
    return j.withColumn("passes", F.coalesce((F.col("oos_sharpe") > 0) & (F.col("oos_drop") < limit), F.lit(False)))
