"""Report queries of the catalogue, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import reports as rp
from ledgerloom.sources.activity_log import trade_key

from . import views as v
from .catalog import DATED, DAYS, PF99, query

DATED.update({"reconciliation": "date", "volatility_shift": "date", "common_days": "date"})


@query("duration_buckets", """SELECT side, CASE WHEN m < 15 THEN 'under 15' WHEN m < 30 THEN '15 to 30' WHEN m < 60 THEN '30 to 60' ELSE '60 and over' END AS bucket, count(*) AS n, sum(profit_loss) AS total, count(*) FILTER (profit_loss > 0) / count(*) AS win_rate
  FROM (SELECT *, (floor(epoch(exit_time)) - floor(epoch(entry_time))) / 60 AS m FROM trades) GROUP BY ALL""", (v.TRADES,), "total win_rate")
def duration_buckets(spark, d):
    return rp.duration_buckets(v.trades(spark, d))


@query("reconciliation", "SELECT CAST(entry_time AS DATE) AS date, count(*) AS n, sum(quantity)::BIGINT AS lots, sum(profit_loss) AS total FROM trades WHERE upper(account_name) = 'ACC_1' AND starts_with(symbol, 'p') GROUP BY 1", (v.TRADES,), "total")
def reconciliation(spark, d):
    return rp.reconciliation(v.trades(spark, d), "acc_1", "p")


@query("favourites", """SELECT account_name, best_dow, best_hour FROM
  (SELECT account_name, dow AS best_dow FROM (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY round(t, 6) DESC, dow) AS r FROM (SELECT account_name, dow, sum(profit_loss) AS t FROM trades GROUP BY ALL)) WHERE r = 1)
  JOIN (SELECT account_name, hour AS best_hour FROM (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY round(t, 6) DESC, hour) AS r FROM (SELECT account_name, hour, sum(profit_loss) AS t FROM trades GROUP BY ALL)) WHERE r = 1) USING (account_name)""", (v.TRADES,))
def favourites(spark, d):
    return rp.favourites(v.trades(spark, d))


@query("attribution_by_hour", "SELECT account_name, hour, total, n, total / nullif(sum(total) OVER (PARTITION BY account_name), 0) AS pnl_share, n / sum(n) OVER (PARTITION BY account_name) AS n_share FROM (SELECT account_name, hour, sum(profit_loss) AS total, count(*) AS n FROM trades GROUP BY ALL)", (v.TRADES,), "total pnl_share n_share")
def attribution_by_hour(spark, d):
    return rp.attribution(v.trades(spark, d), "hour")


@query("account_alerts", """SELECT account_name, alert, n FROM (SELECT account_name, count(*) FILTER (exit_time < entry_time) AS negative_duration, count(*) FILTER (CAST(entry_time AS DATE) < CAST(exit_time AS DATE)) AS overnight, count(*) FILTER (abs(profit_loss) > 300) AS large_result, greatest(count(DISTINCT symbol) - 1, 0) AS several_symbols FROM trades GROUP BY 1)
  UNPIVOT (n FOR alert IN (negative_duration, overnight, large_result, several_symbols)) WHERE n > 0""", (v.TRADES,))
def account_alerts(spark, d):
    return rp.account_alerts(v.trades(spark, d))


@query("consensus", """SELECT symbol, slot, dow, account_name, conviction, least(conviction / 1.5, 1.0) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY symbol, slot, dow ORDER BY conviction DESC, account_name) AS r FROM (
  SELECT symbol, slot, dow, account_name, round(sum(score * CASE w WHEN 28 THEN 0.5 WHEN 14 THEN 0.7 ELSE 1.0 END), 9) AS conviction FROM (
    SELECT *, row_number() OVER (PARTITION BY w, symbol, slot, dow ORDER BY score DESC, account_name) AS k FROM (
      SELECT w, account_name, symbol, slot, dow, round(0.6 * least(2.0, avg(profit_loss) / 25) + 0.4 * least(2.0, avg(profit_loss) / (greatest(coalesce(stddev_samp(profit_loss), 1.0), 1.0) / 10) / 4), 9) AS score
      FROM trades, (SELECT unnest([28, 14, 7]) AS w) WHERE entry_time >= (SELECT max(entry_time) FROM trades) - to_days(w) GROUP BY ALL HAVING count(*) >= 3)) WHERE k = 1 AND score > 0 GROUP BY ALL)) WHERE r = 1 AND conviction > 0.5""", (v.TRADES,), "conviction confidence")
def consensus(spark, d):
    return rp.consensus(v.trades(spark, d), {28: 0.5, 14: 0.7, 7: 1.0})


def _norm(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.5 END"


@query("best_bins", f"""SELECT account_name, symbol, slot, n, mean, win_rate, composite FROM (SELECT *, 0.4 * {_norm('mean')} + 0.3 * {_norm('win_rate')} + 0.3 * {_norm('profit_factor')} AS composite FROM (
  SELECT account_name, symbol, slot, count(*) AS n, avg(profit_loss) AS mean, 100.0 * count(*) FILTER (profit_loss > 0) / count(*) AS win_rate, {PF99.format(s='99.0')} AS profit_factor, avg(profit_loss) FILTER (profit_loss <= 0) AS avg_loser FROM trades GROUP BY ALL HAVING count(*) >= 4)
  WHERE mean > 0 AND profit_factor >= 1.1 AND coalesce(abs(avg_loser), 0) <= 0.25 * 1000) ORDER BY round(composite, 9) DESC, account_name, symbol, slot LIMIT 5""", (v.TRADES,), "mean win_rate composite")
def best_bins(spark, d):
    return rp.best_bins(v.trades(spark, d), 1000.0)


@query("autocorrelation", """SELECT account_name, lag, count(*) AS n, corr(x, y) AS r, abs(corr(x, y)) > 1.96 / sqrt(count(*)) AS significant FROM (
  SELECT account_name, k AS lag, pnl AS x, CASE k WHEN 1 THEN lag(pnl, 1) OVER w WHEN 2 THEN lag(pnl, 2) OVER w ELSE lag(pnl, 3) OVER w END AS y FROM days, (SELECT unnest([1, 2, 3]) AS k) WINDOW w AS (PARTITION BY account_name, k ORDER BY date)) WHERE y IS NOT NULL GROUP BY ALL""", (v.TRADES, DAYS), "r")
def autocorrelation(spark, d):
    return rp.autocorrelation(v.trades(spark, d))


@query("volatility_shift", """SELECT account_name, date, ratio FROM (SELECT account_name, date, stddev_pop(pnl) OVER a / nullif(stddev_pop(pnl) OVER b, 0) AS ratio, count(*) OVER a AS na, count(*) OVER b AS nb FROM days
  WINDOW a AS (PARTITION BY account_name ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), b AS (PARTITION BY account_name ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE na = 5 AND nb = 5 AND (ratio > 2 OR ratio < 0.5)""", (v.TRADES, DAYS), "ratio")
def volatility_shift(spark, d):
    return rp.volatility_shift(v.trades(spark, d))


@query("downsampled", "SELECT trade_id, account_name FROM (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY entry_time, trade_id) - 1 AS i, greatest(floor(count(*) OVER (PARTITION BY account_name) / 50), 1)::BIGINT AS k FROM trades) WHERE i % k = 0", (v.TRADES,))
def downsampled(spark, d):
    return rp.downsampled(v.trades(spark, d), 50, "account_name").select("trade_id", "account_name")


@query("latest_trades", "SELECT trade_id, account_name, symbol, profit_loss FROM (SELECT *, row_number() OVER (PARTITION BY account_name, symbol ORDER BY entry_time DESC, trade_id DESC) AS r FROM trades) WHERE r = 1", (v.TRADES,), "profit_loss")
def latest_trades(spark, d):
    return rp.latest(v.trades(spark, d), ["account_name", "symbol"], "entry_time", "trade_id").select("trade_id", "account_name", "symbol", "profit_loss")


@query("common_days", "SELECT CAST(entry_time AS DATE) AS date FROM trades WHERE account_name = 'ACC_1' INTERSECT SELECT CAST(entry_time AS DATE) FROM trades WHERE account_name = 'ACC_2'", (v.TRADES,))
def common_days(spark, d):
    return rp.common_days(v.trades(spark, d), "ACC_1", "ACC_2")


@query("only_first_slots", "SELECT DISTINCT slot FROM trades WHERE account_name = 'ACC_1' AND quantity = 1 AND symbol = 'error' EXCEPT SELECT slot FROM trades WHERE account_name = 'ACC_2' AND quantity = 1 AND symbol = 'error'", (v.TRADES,))
def only_first_slots(spark, d):
    return rp.only_first(v.trades(spark, d).filter("quantity = 1 and symbol = 'error'"), "ACC_1", "ACC_2")


@query("stress", "SELECT account_name, scenario, sum(CASE WHEN profit_loss > 0 THEN profit_loss ELSE 0 END) + sum(CASE WHEN profit_loss <= 0 THEN profit_loss ELSE 0 END) * factor AS total FROM trades, (VALUES ('mild', 1.25::DOUBLE), ('severe', 2.0::DOUBLE)) s(scenario, factor) GROUP BY account_name, scenario, factor", (v.TRADES,), "total")
def stress(spark, d):
    return rp.stress(v.trades(spark, d), {"mild": 1.25, "severe": 2.0})


@query("trade_keys", "SELECT trade_id, 'T' || substr(md5(concat_ws('_', account_name, symbol, side, quantity::VARCHAR, trade_id::VARCHAR)), 1, 12) AS trade_key FROM trades", (v.TRADES,))
def trade_keys(spark, d):
    return v.trades(spark, d).select("trade_id", trade_key("account_name", "symbol", "side", "quantity", "trade_id").alias("trade_key"))


@query("trade_page", "SELECT trade_id, account_name, profit_loss FROM trades WHERE upper(account_name) = 'ACC_3' AND starts_with(symbol, 'view') ORDER BY entry_time DESC, trade_id LIMIT 25 OFFSET 50", (v.TRADES,), "profit_loss")
def trade_page(spark, d):
    own = v.trades(spark, d).filter((F.upper("account_name") == "ACC_3") & F.startswith(F.col("symbol"), F.lit("view")))
    return own.orderBy(F.desc("entry_time"), "trade_id").offset(50).limit(25).select("trade_id", "account_name", "profit_loss")
