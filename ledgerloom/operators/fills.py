"""Fills: plausibility, ghosts, duplicates, and matching into round trips, without row-at-a-time code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.lineage import cut

from .scans import running

BOOK = ["account", "symbol", "session"]


def plausible(fills: DataFrame, max_quantity: int = 50) -> DataFrame:
    return fills.filter(F.col("side").isin("BUY", "SELL") & (F.col("price") > 0) & F.col("quantity").between(1, max_quantity))


#: Marks of a strategy in messages. Fixed values.
TAGS = "autotrader_|at_|text: tag:"


def ghost(local_minutes: Column, message: str | None = None) -> Column:
    """A fill of several lots that opens, outside the minutes around the close, without a note or a strategy's mark in its message."""
    at_close = local_minutes.between(16 * 60 + 55, 17 * 60 + 5)
    noted = F.coalesce(F.col("note").rlike("[A-Za-z0-9]"), F.lit(False))
    if message:
        noted = noted | F.coalesce(F.lower(message).rlike(TAGS), F.lit(False))
    return (F.col("quantity") > 1) & ~at_close & (F.coalesce("open_close", F.lit("")) != "CLOSE") & ~noted


def classified(fills: DataFrame, local_minutes: Column, *, min_note_rate: float = 0.25, min_fills: int = 5, by: tuple[str, ...] = ("account", "symbol"), message: str | None = None) -> DataFrame:
    """Adds ``is_ghost``; where hardly any fill of a group (``by``: an account's symbol, or that of one file) is noted, nothing is a ghost."""
    noted = F.avg(F.when(F.trim("note") != "", 1.0).otherwise(0.0))
    sparse = fills.groupBy(*by).agg(((noted < min_note_rate) & (F.count("*") > min_fills)).alias("bypass"))
    marked = fills.join(sparse, list(by))
    return marked.withColumn("is_ghost", ghost(local_minutes, message) & ~F.col("bypass")).drop("bypass")


def deduplicated(fills: DataFrame, per_second: int = 4, extra: tuple[str, ...] = ()) -> DataFrame:
    """One fill of each bucket of time, price, side, quantity, account and ``extra`` columns (an order id): noted ones first, then those
    that are no ghosts if that is known, then the earliest."""
    bucket = F.bround(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 * per_second)
    known = [F.when(F.col("is_ghost"), 1).otherwise(0)] if "is_ghost" in fills.columns else []
    w = Window.partitionBy("account", "symbol", "side", "quantity", "price", "bucket", *extra).orderBy(F.when(F.col("note") != "", 0).otherwise(1), *known, "ts", "fill_id")
    return fills.withColumn("bucket", bucket).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "bucket")


def engine(fills: DataFrame, local: Column, session: Column, *, by: tuple[str, ...] = ("account", "symbol"), extra: tuple[str, ...] = (), message: str | None = None) -> DataFrame:
    """The chain from raw fills to those that are paired, each with its ``session``: plausible ones, repeats dropped, ghosts dropped, and
    in books that lost ghosts the closes dropped that meet a flat position.

    Fills are read several times after this (both sides of a match, sums and their carries), so the result is a checkpoint."""
    from .matching import orphaned_closes

    minutes = F.hour(local) * 60 + F.minute(local)
    marked = cut(classified(plausible(fills), minutes, by=by, message=message).withColumn("session", session))
    ghosts, real = marked.filter("is_ghost"), cut(deduplicated(marked.filter("not is_ghost"), extra=extra))
    return cut(real.join(orphaned_closes(real, ghosts), "fill_id", "left_anti"))


def fifo(fills: DataFrame) -> DataFrame:
    """First-in-first-out round trips per account, symbol and session.

    Within a session the k-th lot bought meets the k-th lot sold, since an open queue never holds both sides. So both sides
    are laid out as intervals of cumulative lots, and overlapping intervals are trades: the overlap is the quantity, the
    earlier fill the entry. The session is part of the join key, and lots are binned, so no pair that cannot overlap is
    tried. Cumulative lots are a scan over the hours of a book, so no book is one task.
    """
    laid = running(fills, [*BOOK, "side"], ["ts", "fill_id"], F.date_trunc("hour", "ts"), {"hi": F.col("quantity").cast("long")}).withColumn("lo", F.col("hi") - F.col("quantity"))
    width = 64
    binned = laid.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    side = lambda s, p: binned.filter(F.col("side") == s).select(*BOOK, "bin", *[F.col(c).alias(p + c) for c in ("lo", "hi", "ts", "price", "fill_id")])
    pair = side("BUY", "b_").join(side("SELL", "s_"), [*BOOK, "bin"])
    lo, hi = F.greatest("b_lo", "s_lo"), F.least("b_hi", "s_hi")
    pair = pair.filter((lo < hi) & (F.floor(lo / width) == F.col("bin")))  # each overlap counts in its first bin
    long = (F.col("b_ts") < F.col("s_ts")) | ((F.col("b_ts") == F.col("s_ts")) & (F.col("b_fill_id") < F.col("s_fill_id")))
    pick = lambda c, first: F.when(long if first else ~long, F.col("b_" + c)).otherwise(F.col("s_" + c))
    return pair.select(
        *BOOK,
        F.when(long, "LONG").otherwise("SHORT").alias("direction"),
        (hi - lo).cast("long").alias("quantity"),
        pick("ts", True).alias("entry_time"),
        pick("ts", False).alias("exit_time"),
        pick("price", True).alias("entry_price"),
        pick("price", False).alias("exit_price"),
        ((F.col("s_price") - F.col("b_price")) * (hi - lo)).alias("points"),
    )


def open_positions(fills: DataFrame) -> DataFrame:
    """Lots left open at the end of each session."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    return fills.groupBy(*BOOK).agg(F.sum(signed).cast("long").alias("position"), F.count("*").alias("n")).filter("position <> 0")


def position_zero(fills: DataFrame) -> DataFrame:
    """Trades between two flat positions: volume-weighted entry and exit."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    w = Window.partitionBy(*BOOK).orderBy("ts", "fill_id")
    run = fills.withColumn("q", signed).withColumn("pos", F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    zeros = F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seg = run.withColumn("segment", F.coalesce(zeros, F.lit(0)))
    buy, sell = F.when(F.col("q") > 0, F.col("q")), F.when(F.col("q") < 0, -F.col("q"))
    vwap = lambda q: F.sum(q * F.col("price")) / F.sum(q)
    done = seg.groupBy(*BOOK, "segment").agg(F.sum("q").alias("net"), F.sum(buy).alias("bought"), vwap(buy).alias("buy_vwap"), vwap(sell).alias("sell_vwap"), F.count("*").alias("n"))
    return done.filter("net = 0").select(*BOOK, "segment", F.col("bought").cast("long").alias("quantity"), "buy_vwap", "sell_vwap", ((F.col("sell_vwap") - F.col("buy_vwap")) * F.col("bought")).alias("points"), "n")


def sequence_check(fills: DataFrame) -> DataFrame:
    """Per book: final position and how often the position changed sign."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    w = Window.partitionBy(*BOOK).orderBy("ts", "fill_id")
    run = fills.withColumn("pos", F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flip = F.signum(F.col("pos")) * F.signum(F.lag("pos").over(w)) < 0
    return run.withColumn("flip", flip).groupBy(*BOOK).agg(F.sum(signed).cast("long").alias("final"), F.count_if(F.col("flip")).alias("flips"))


def purge(trades: DataFrame, now: Column, entry_local: Column, exit_local: Column, *, sigmas: float = 5.0, least: float = 4000.0) -> DataFrame:
    """Every trade with the first rule it breaks, or null. Sigma is that of the trades that the earlier rules leave."""
    from ledgerloom.functions.timeplane import crosses_close

    seconds = F.unix_timestamp(F.col("exit_time").cast("timestamp")) - F.unix_timestamp(F.col("entry_time").cast("timestamp"))
    early = F.when(F.col("exit_time") > now + F.expr("INTERVAL 5 MINUTES"), "future").when(seconds < 0, "negative").when(seconds > 86400, "too_long").when(crosses_close(entry_local, exit_local), "crosses_close")
    p = F.when(F.col("early").isNull(), F.col("profit_loss"))
    first = trades.withColumn("early", early)
    marked = first.join(first.groupBy("account_name").agg(F.avg(p).alias("mu"), F.stddev_pop(p).alias("sigma")), "account_name")
    far = (F.abs(F.col("profit_loss") - F.col("mu")) > sigmas * F.col("sigma")) & (F.abs("profit_loss") > least)
    return marked.withColumn("reason", F.coalesce("early", F.when(far, "outlier"))).drop("early", "mu", "sigma")
