"""Trade views over the driver's tables, for Spark and (as CTEs) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import timeplane as tp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday trades from ``events``."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    local = tp.new_york(F.col("ts"))
    return e.select(
        F.col("event_id").alias("trade_id"),
        F.concat(F.lit("ACC_"), (F.col("user_id") % 4).cast("string")).alias("account_name"),
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("entry_time"),
        (F.col("ts") + F.make_dt_interval(mins=k + 1)).alias("exit_time"),
        (k % 3 + 1).cast("int").alias("quantity"),
        F.when(k % 2 == 0, "LONG").otherwise("SHORT").alias("side"),
        (F.col("value") - 35).alias("profit_loss"),
        tp.slot(local).alias("slot"),
        tp.weekday(local).alias("dow"),
        F.hour(local).cast("int").alias("hour"),
    )


TRADES = """trades AS (
  SELECT *, lpad(date_part('hour', ny)::VARCHAR, 2, '0') || ':' || CASE WHEN date_part('minute', ny) < 30 THEN '00' ELSE '30' END AS slot,
    (isodow(ny) - 1)::INTEGER AS dow, date_part('hour', ny)::INTEGER AS hour
  FROM (SELECT event_id AS trade_id, 'ACC_' || (user_id % 4) AS account_name, event_type AS symbol, ts AS entry_time,
      ts + to_minutes(k + 1) AS exit_time, (k % 3 + 1)::INTEGER AS quantity, CASE WHEN k % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side,
      value - 35 AS profit_loss, timezone('America/New_York', timezone('UTC', ts)) AS ny
    FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events)))"""


def daily_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-year trades from ``lineitem`` and ``orders``."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = line.join(orders.select("o_orderkey", "o_orderdate"), line.l_orderkey == F.col("o_orderkey"))
    return joined.select(
        F.concat(F.lit("ACC_"), (F.col("l_suppkey") % 10).cast("string")).alias("account_name"),
        F.col("l_returnflag").alias("symbol"),
        F.col("l_linenumber").alias("slot"),
        F.col("o_orderdate").alias("entry_time"),
        F.col("l_shipdate").alias("exit_time"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 40000).alias("profit_loss"),
    )


DAILY = """daily AS (
  SELECT 'ACC_' || (l_suppkey % 10) AS account_name, l_returnflag AS symbol, l_linenumber AS slot, o_orderdate AS entry_time,
    l_shipdate AS exit_time, l_quantity AS quantity, l_extendedprice * (1 - l_discount) - 40000 AS profit_loss
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order fills from ``events``."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("fill_id"),
        F.concat(F.lit("ACC_"), (F.col("user_id") % 4).cast("string")).alias("account"),
        F.when(F.col("user_id") % 2 == 0, "NQ").otherwise("ES").alias("symbol"),
        F.col("ts"),
        F.when(F.col("event_type").isin("view", "signup"), "BUY").otherwise("SELL").alias("side"),
        (k % 3 + 1).cast("int").alias("quantity"),
        F.col("value").alias("price"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("note"), k.cast("string"))).alias("note"),
        F.when(k % 7 == 0, "CLOSE").otherwise("OPEN").alias("open_close"),
    )


FILLS = """fills AS (
  SELECT event_id AS fill_id, 'ACC_' || (user_id % 4) AS account, CASE WHEN user_id % 2 = 0 THEN 'NQ' ELSE 'ES' END AS symbol, ts,
    CASE WHEN event_type IN ('view', 'signup') THEN 'BUY' ELSE 'SELL' END AS side, (k % 3 + 1)::INTEGER AS quantity, value AS price,
    CASE WHEN k % 5 = 0 THEN '' ELSE 'note' || k END AS note, CASE WHEN k % 7 = 0 THEN 'CLOSE' ELSE 'OPEN' END AS open_close
  FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events))"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily volatility index: the mean event value of each day but every fifth, scaled into about 10 to 35."""
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").groupBy(day.alias("date")).agg((F.avg("value") / 2).alias("close")).filter(F.dayofmonth("date") % 5 != 0)


MARKET = """market AS (
  SELECT CAST(ts AS DATE) AS date, avg(value) / 2 AS close FROM events GROUP BY 1 HAVING date_part('day', CAST(ts AS DATE)) % 5 <> 0)"""


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills with parent orders from ``events``: two events make an order, the even one opens, the odd one closes."""
    k = F.get_json_object("props", "$.k").cast("int")
    parent = F.floor(F.col("event_id") / 2).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("fill_id"),
        parent.alias("parent_id"),
        F.concat(F.lit("ACC_"), (parent % 4).cast("string")).alias("account"),
        F.when(parent % 3 == 0, "NQ").otherwise("ES").alias("symbol"),
        F.col("ts"),
        F.when((F.col("event_id") + parent) % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        (k % 3 + 1).cast("int").alias("quantity"),
        F.col("value").alias("price"),
        F.when(F.col("event_id") % 2 == 0, "OPEN").otherwise("CLOSE").alias("open_close"),
    )


ORDERS_LOG = """orders_log AS (
  SELECT event_id AS fill_id, event_id // 2 AS parent_id, 'ACC_' || ((event_id // 2) % 4) AS account, CASE WHEN (event_id // 2) % 3 = 0 THEN 'NQ' ELSE 'ES' END AS symbol, ts,
    CASE WHEN (event_id + event_id // 2) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, (k % 3 + 1)::INTEGER AS quantity, value AS price, CASE WHEN event_id % 2 = 0 THEN 'OPEN' ELSE 'CLOSE' END AS open_close
  FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events))"""
