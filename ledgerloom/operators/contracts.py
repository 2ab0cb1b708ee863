"""Contracts: base symbols of contract codes, their multipliers and price bounds, and profits in money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base symbol, money a point, lowest and highest plausible price.
SYMBOLS = [
    ("ES", 50.0, 500.0, 10000.0), ("NQ", 20.0, 1000.0, 50000.0), ("YM", 5.0, 5000.0, 100000.0), ("RTY", 50.0, 200.0, 5000.0), ("FDAX", 25.0, 1000.0, 50000.0),
    ("MES", 5.0, 500.0, 10000.0), ("MNQ", 2.0, 1000.0, 50000.0), ("MYM", 0.5, 5000.0, 100000.0), ("M2K", 5.0, 200.0, 5000.0), ("CL", 1000.0, 20.0, 200.0),
    ("MCL", 100.0, 20.0, 200.0), ("GC", 100.0, 500.0, 5000.0), ("SI", 5000.0, 10.0, 100.0), ("ZB", 1000.0, 50.0, 200.0), ("ZN", 1000.0, 50.0, 200.0),
    ("ZF", 1000.0, 50.0, 200.0), ("ZT", 2000.0, 90.0, 120.0),
]
MULTIPLIER, COMMISSION = 1.0, 4.2  # of symbols that are not listed; commission of a round-turn lot


def dimension(spark: SparkSession) -> DataFrame:
    """The listed symbols as a table; so small that joins broadcast it by themselves."""
    return spark.createDataFrame(SYMBOLS, "base_symbol string, multiplier double, price_min double, price_max double")


def base_symbol(raw: Column) -> Column:
    """The base symbol of a contract code such as NQH26, F.US.MNQH23 or M2KM26; the code itself where nothing fits.

    The part after the last dot counts, without a month letter and year; then the longest listed symbol it begins with.
    (The surveyed lookup resolves M2K contracts to M; here they are M2K.)
    """
    code = F.regexp_replace(F.upper(F.trim(raw)), r"^.*\.", "")
    bare = F.regexp_replace(code, r"^([A-Z0-9]{2,}?)[FGHJKMNQUVXZ][0-9]{1,2}$", "$1")
    known = sorted((s for s, *_ in SYMBOLS), key=lambda s: (-len(s), s))
    exact = F.when(bare.isin(known), bare)
    return F.coalesce(exact, *[F.when(F.startswith(bare, F.lit(s)), F.lit(s)) for s in known], bare)


def priced(trips: DataFrame, symbol_col: str = "symbol", commission: float = COMMISSION) -> DataFrame:
    """Round trips with ``multiplier``, ``gross`` (points of all lots in money), ``net`` of commission, and signed ``minutes``."""
    dim = dimension(trips.sparkSession).select("base_symbol", "multiplier")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    joined = trips.withColumn("base_symbol", base_symbol(F.col(symbol_col))).join(dim, "base_symbol", "left")
    money = joined.withColumn("multiplier", F.coalesce("multiplier", F.lit(MULTIPLIER))).withColumn("gross", F.col("points") * F.col("multiplier"))
    return money.withColumn("net", F.col("gross") - commission * F.col("quantity")).withColumn("minutes", (seconds("exit_time") - seconds("entry_time")) / 60)


def implausible(fills: DataFrame, symbol_col: str = "symbol", max_quantity: int = 50) -> DataFrame:
    """Fills with the first reason why they are rejected (null: kept). Unknown symbols are kept and marked ``unknown_symbol``."""
    joined = fills.withColumn("base_symbol", base_symbol(F.col(symbol_col))).join(dimension(fills.sparkSession), "base_symbol", "left")
    reason = (
        F.when(~F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(False)), "side")
        .when(~F.coalesce(F.col("price") > 0, F.lit(False)), "price")
        .when(~F.coalesce(F.col("quantity").between(1, max_quantity), F.lit(False)), "quantity")
        .when((F.col("price") < F.col("price_min")) | (F.col("price") > F.col("price_max")), "price_bounds")
    )
    return joined.withColumn("rejected", reason).withColumn("unknown_symbol", F.col("price_min").isNull()).drop("multiplier", "price_min", "price_max")
