"""Further queries of the catalogue, and their SQL: edges, contracts, volatility, checks, matching, rolling features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import timeplane as tp
from ledgerloom.operators import checks as ck
from ledgerloom.operators import contracts as ct
from ledgerloom.operators import edges as ed
from ledgerloom.operators import fills as fl
from ledgerloom.operators import matching as mc
from ledgerloom.operators import rolling as ro
from ledgerloom.operators import significance as sg
from ledgerloom.operators import volatility as vo
from ledgerloom.streaming import monitor as mo

from . import views as v
from .catalog import BOOKED, DATED, DAYS, FRESH, SQL, STATS, _booked, query

DATED.update({"follow_daily": "date", "order_matches": "date", "model_age": "date trained"})

CELLS = f"""cells AS (SELECT s.*, m.persistence, m.months, s.mean * s.win_rate / 100 AS edge FROM ({STATS.format(t='fresh', k=3)}) s JOIN (
  SELECT account_name, symbol, slot, dow, 100.0 * count(*) FILTER (pnl > 0) / count(*) AS persistence, count(*) AS months FROM (
    SELECT account_name, symbol, slot, dow, strftime(entry_time, '%Y-%m') AS month, sum(profit_loss) AS pnl FROM fresh GROUP BY ALL) GROUP BY ALL) m USING (account_name, symbol, slot, dow))"""
_BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, slot, dow ORDER BY {order}, account_name) AS r FROM cells) WHERE r = 1 AND mean > 0 AND win_rate >= 0 AND persistence >= 0"
BY_PERSISTENCE = _BEST.format(order="persistence DESC, mean DESC, win_rate DESC")
KEPT = ["account_name", "symbol", "slot", "dow", "n", "mean", "win_rate", "persistence", "months"]


@query("slot_matrix_persistence", f"SELECT {', '.join(KEPT)} FROM ({BY_PERSISTENCE})", (v.TRADES, FRESH, CELLS), "mean win_rate persistence")
def slot_matrix_persistence(spark, d):
    return ed.matrix(v.trades(spark, d)).select(*KEPT)


@query("slot_matrix_statistical", f"SELECT {', '.join(KEPT)} FROM ({_BEST.format(order='edge DESC, mean DESC')})", (v.TRADES, FRESH, CELLS), "mean win_rate persistence")
def slot_matrix_statistical(spark, d):
    return ed.matrix(v.trades(spark, d), "statistical").select(*KEPT)


@query("slot_matrix_steady", f"SELECT {', '.join(KEPT)} FROM ({_BEST.format(order='win_rate DESC, mean DESC')})", (v.TRADES, FRESH, CELLS), "mean win_rate persistence")
def slot_matrix_steady(spark, d):
    return ed.matrix(v.trades(spark, d), "steady").select(*KEPT)


@query("slot_matrix_labels", f"""SELECT account_name, symbol, slot, dow, mean, recent_mean, recent_n, status, CASE WHEN recent_n < 5 THEN 90 WHEN status = 'STABLE' THEN 100 WHEN status = 'DRIFTING' THEN 70 ELSE 30 END AS health FROM (
  SELECT *, CASE WHEN recent_n < 5 OR recent_mean >= 0.9 * mean THEN 'STABLE' WHEN recent_mean > 0 THEN 'DRIFTING' ELSE 'CRITICAL' END AS status FROM ({BY_PERSISTENCE}) JOIN (
    SELECT account_name, symbol, slot, dow, avg(profit_loss) AS recent_mean, count(*) AS recent_n FROM trades WHERE entry_time >= (SELECT max(entry_time) FROM trades) - INTERVAL 10 DAY GROUP BY ALL) USING (account_name, symbol, slot, dow)
  WHERE account_name NOT IN ('ACC_3'))""", (v.TRADES, FRESH, CELLS), "mean recent_mean")
def slot_matrix_labels(spark, d):
    t = v.trades(spark, d)
    return ed.labelled(ed.matrix(t), t, days=10, banned=("ACC_3",)).select("account_name", "symbol", "slot", "dow", "mean", "recent_mean", "recent_n", "status", "health")


FOLLOWED = f"followed AS (SELECT * FROM trades SEMI JOIN ({BY_PERSISTENCE}) USING (account_name, symbol, slot, dow))"


@query("follow_daily", "SELECT date, pnl, n, sum(pnl) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM (SELECT CAST(entry_time AS DATE) AS date, sum(profit_loss) AS pnl, count(*) AS n FROM followed GROUP BY 1)", (v.TRADES, FRESH, CELLS, FOLLOWED), "pnl equity")
def follow_daily(spark, d):
    t = v.trades(spark, d)
    return ed.daily_equity(ed.followed(t, ed.matrix(t)))


@query("follow_stats", """SELECT n, total, mean, win_rate, avg_winner, avg_loser, profit_factor, days, mean / nullif(sigma, 0) * sqrt(n / days * 252) AS sharpe, mean / nullif(sqrt((SELECT sum(pow(least(profit_loss - m.mean, 0), 2)) FROM followed, m) / (n - 1)), 0) * sqrt(n / days * 252) AS sortino,
  (SELECT max(greatest(peak, 0) - equity) FROM (SELECT equity, max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT date, sum(pnl) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM (SELECT CAST(entry_time AS DATE) AS date, sum(profit_loss) AS pnl FROM followed GROUP BY 1)))) AS worst_drop FROM m""",
  (v.TRADES, FRESH, CELLS, FOLLOWED, """m AS (SELECT count(*) AS n, sum(profit_loss) AS total, avg(profit_loss) AS mean, stddev_samp(profit_loss) AS sigma, 100.0 * count(*) FILTER (profit_loss > 0) / count(*) AS win_rate, avg(profit_loss) FILTER (profit_loss > 0) AS avg_winner, avg(profit_loss) FILTER (profit_loss < 0) AS avg_loser,
  sum(profit_loss) FILTER (profit_loss > 0) / nullif(abs(sum(profit_loss) FILTER (profit_loss < 0)), 0) AS profit_factor, count(DISTINCT CAST(entry_time AS DATE)) AS days FROM followed)"""), "total mean win_rate avg_winner avg_loser profit_factor sharpe sortino worst_drop")
def follow_stats(spark, d):
    t = v.trades(spark, d)
    return ed.combined_stats(ed.followed(t, ed.matrix(t)))


@query("uncrowded_profit", "SELECT account_name, count(*) AS n, sum(profit_loss) AS total FROM (SELECT *, count(*) OVER (PARTITION BY account_name, symbol, CAST(entry_time AS DATE)) AS k FROM trades) WHERE k <= 20 GROUP BY 1", (v.TRADES,), "total")
def uncrowded_profit(spark, d):
    return ed.uncrowded(v.trades(spark, d), ["symbol"], 20).groupBy("account_name").agg(F.count("*").alias("n"), F.sum("profit_loss").alias("total"))


def _month_ctes(train: int, test: int, expanding: bool, having: str) -> tuple[str, ...]:
    begin = "0" if expanding else f"fold * {test}"
    return (
        v.DAILY,
        "months AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i FROM (SELECT DISTINCT strftime(entry_time, '%Y-%m') AS month FROM daily))",
        f"folds AS (SELECT unnest(range(0, CAST(floor(((SELECT count(*) FROM months) - {train} - {test}) / {test}) AS BIGINT) + 1)) AS fold)",
        f"""spans AS (SELECT fold, CASE WHEN i < fold * {test} + {train} THEN 'train' ELSE 'test' END AS role, month FROM folds JOIN months ON i >= {begin} AND i < fold * {test} + {train + test})""",
        f"""picks AS (SELECT fold, account_name, symbol, slot FROM (SELECT *, row_number() OVER (PARTITION BY fold, symbol, slot ORDER BY persistence DESC, round(p, 6) DESC, account_name) AS r FROM (
          SELECT fold, account_name, symbol, slot, sum(pnl) AS p, sum(k) AS n, count(*) AS months, 100.0 * count(*) FILTER (pnl > 0) / count(*) AS persistence FROM (
            SELECT account_name, symbol, slot, strftime(entry_time, '%Y-%m') AS month, sum(profit_loss) AS pnl, count(*) AS k FROM daily GROUP BY ALL) JOIN spans USING (month) WHERE role = 'train' GROUP BY ALL) WHERE {having}) WHERE r = 1)""",
        "oos AS (SELECT fold, d.* FROM (SELECT *, strftime(entry_time, '%Y-%m') AS month FROM daily) d JOIN spans USING (month) WHERE role = 'test')",
        "kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY fold, account_name, symbol, slot, CAST(entry_time AS DATE)) AS crowd FROM oos SEMI JOIN picks USING (fold, account_name, symbol, slot)) WHERE crowd <= 200)",
    )


_PERSISTENT = "persistence >= 50 AND p > 0 AND n >= 5 AND months >= 2"
_FOLD = "SELECT fold, count(*) AS n, sum(profit_loss) AS total, count(*) FILTER (profit_loss > 0) / count(*) AS win_rate, avg(profit_loss) AS mean, stddev_samp(profit_loss) AS volatility, avg(profit_loss) / nullif(stddev_samp(profit_loss), 0) AS sharpe FROM kept GROUP BY 1"
CELL = ["symbol", "slot"]


@query("month_walk_forward", _FOLD, _month_ctes(6, 1, False, _PERSISTENT), "total win_rate mean volatility sharpe")
def month_walk_forward(spark, d):
    return ed.fold_metrics(ed.month_days(ed.cell_days(v.daily_trades(spark, d), CELL), CELL))


@query("month_walk_forward_expanding", _FOLD, _month_ctes(12, 3, True, "p > 0 AND persistence > 50 AND n >= 5"), "total win_rate mean volatility sharpe")
def month_walk_forward_expanding(spark, d):
    return ed.fold_metrics(ed.month_days(ed.cell_days(v.daily_trades(spark, d), CELL), CELL, train=12, test=3, expanding=True, logic="statistical"))


@query("oos_equity", "SELECT month, n, total, sum(total) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS equity FROM (SELECT month, count(*) AS n, sum(profit_loss) AS total FROM kept GROUP BY 1)", _month_ctes(6, 1, False, _PERSISTENT), "total equity")
def oos_equity(spark, d):
    from pyspark.sql import Window

    months = ed.month_days(ed.cell_days(v.daily_trades(spark, d), CELL), CELL).groupBy("month").agg(F.sum("n").alias("n"), F.sum("pnl").alias("total"))
    return months.withColumn("equity", F.sum("total").over(Window.partitionBy(F.lit(1)).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


def _loss(n: str) -> str:
    return f"coalesce(({n}_in - {n}_out){' * -1' if n == 'volatility' else ''} / nullif(abs({n}_in), 0), 0)"


_SIDES = ", ".join(
    f"coalesce(avg(profit_loss) FILTER (role = '{r}') / nullif(stddev_samp(profit_loss) FILTER (role = '{r}'), 0), 0) AS sharpe_{s}, avg(CASE WHEN profit_loss > 0 THEN 1.0 ELSE 0.0 END) FILTER (role = '{r}') AS win_rate_{s}, avg(profit_loss) FILTER (role = '{r}') AS mean_{s}, coalesce(stddev_samp(profit_loss) FILTER (role = '{r}'), 0) AS volatility_{s}"
    for r, s in (("train", "in"), ("test", "out"))
)


@query("fold_degradation", f"""SELECT *, 0.4 * greatest(1 - (abs(sharpe_loss) + abs(win_rate_loss) + abs(mean_loss)) / 3 / 0.3, 0) + 0.3 * least(greatest(sharpe_out, 0), 1) + 0.3 * least(greatest((win_rate_out - 0.5) / 0.1, 0), 1) AS robustness FROM (
  SELECT fold, n_out, sharpe_out, win_rate_out, {', '.join(f'{_loss(n)} AS {n}_loss' for n in ('sharpe', 'win_rate', 'mean', 'volatility'))} FROM (
    SELECT fold, {_SIDES}, count(profit_loss) FILTER (role = 'test') AS n_out FROM (SELECT *, strftime(entry_time, '%Y-%m') AS month FROM daily) JOIN spans USING (month) SEMI JOIN picks USING (fold, account_name, symbol, slot) GROUP BY fold) WHERE n_out > 0)""", _month_ctes(12, 3, False, _PERSISTENT), "sharpe_out win_rate_out sharpe_loss win_rate_loss mean_loss volatility_loss robustness")
def fold_degradation(spark, d):
    return ed.degradation(v.daily_trades(spark, d), CELL, train=12, test=3)


def _logic_sql() -> tuple[str, tuple[str, ...]]:
    base = _month_ctes(12, 3, False, _PERSISTENT)
    having = {"persistence": _PERSISTENT, "classic": "p > 0 AND p / n > 10 AND n >= 5", "statistical": "p > 0 AND persistence > 50 AND n >= 5"}
    ctes = list(base[:4])
    for logic, h in having.items():
        picks, oos, kept = _month_ctes(12, 3, False, h)[4:]
        ctes += [picks.replace("picks AS", f"picks_{logic} AS", 1), oos.replace("oos AS", f"oos_{logic} AS", 1), kept.replace("kept AS", f"kept_{logic} AS", 1).replace("FROM oos SEMI JOIN picks", f"FROM oos_{logic} SEMI JOIN picks_{logic}")]
    each = " UNION ALL ".join(f"SELECT '{logic}' AS logic, fold, sum(profit_loss) AS t FROM kept_{logic} GROUP BY fold" for logic in having)
    return f"""SELECT *, consistency + CASE WHEN consistency >= 100 THEN 20 WHEN consistency >= 70 THEN 10 ELSE 0 END + 5 * sharpe AS score FROM (
      SELECT logic, count(*) AS folds, sum(t) AS total, 100.0 * count(*) FILTER (t > 0) / count(*) AS consistency, coalesce(avg(t) / nullif(stddev_pop(t), 0), 0) AS sharpe FROM ({each}) GROUP BY 1)""", tuple(ctes)


@query("logic_comparison", _logic_sql()[0], _logic_sql()[1], "total consistency sharpe score")
def logic_comparison(spark, d):
    return ed.compared_logics(v.daily_trades(spark, d), CELL, train=12, test=3)


CODES = """codes AS (SELECT event_id, ['MNQ', 'ES', 'F.US.NQ', 'cl', 'GC', 'M2K', 'ZB', 'XYZ'][(event_id % 8 + 1)::BIGINT] || ['H', 'M', 'U', 'Z'][(event_id % 4 + 1)::BIGINT] || (20 + event_id % 7) AS code FROM events)"""


def _codes(spark, d):
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs)).cast("int"))
    code = F.concat(pick(["MNQ", "ES", "F.US.NQ", "cl", "GC", "M2K", "ZB", "XYZ"]), pick(["H", "M", "U", "Z"]), (20 + F.col("event_id") % 7).cast("string"))
    return v.table(spark, d, "events").select("event_id", code.alias("code"))


@query("base_symbols", "SELECT code, ['MNQ', 'ES', 'NQ', 'CL', 'GC', 'M2K', 'ZB', 'XYZ'][(event_id % 8 + 1)::BIGINT] AS base_symbol, [2.0, 50.0, 20.0, 1000.0, 100.0, 5.0, 1000.0, 1.0][(event_id % 8 + 1)::BIGINT]::DOUBLE AS multiplier, count(*) AS n FROM codes GROUP BY ALL", (CODES,))
def base_symbols(spark, d):
    named = _codes(spark, d).withColumn("base_symbol", ct.base_symbol(F.col("code"))).join(ct.dimension(spark), "base_symbol", "left")
    return named.groupBy("code", "base_symbol", F.coalesce("multiplier", F.lit(ct.MULTIPLIER)).alias("multiplier")).agg(F.count("*").alias("n"))


@query("fifo_money", f"""SELECT account, symbol, direction, count(*) AS n, sum(quantity)::BIGINT AS lots, sum(points * m) AS gross, sum(points * m - 4.2 * quantity) AS net, avg(epoch(exit_time - entry_time) / 60) AS minutes FROM (
  SELECT *, CASE symbol WHEN 'NQ' THEN 20 ELSE 50 END AS m FROM ({SQL['fifo_round_trips'].split('result AS (', 1)[1].rsplit(') SELECT', 1)[0]})) GROUP BY ALL""",
  (v.FILLS, BOOKED, "laid AS (SELECT *, sum(quantity) OVER (PARTITION BY account, symbol, session, side ORDER BY ts, fill_id ROWS UNBOUNDED PRECEDING) AS hi FROM clean)"), "gross net minutes")
def fifo_money(spark, d):
    t = ct.priced(fl.fifo(_booked(spark, d)))
    return t.groupBy("account", "symbol", "direction").agg(F.count("*").alias("n"), F.sum("quantity").alias("lots"), F.sum("gross").alias("gross"), F.sum("net").alias("net"), F.avg("minutes").alias("minutes"))


@query("rejected_fills", """SELECT symbol, rejected, count(*) AS n FROM (SELECT *, CASE WHEN side NOT IN ('BUY', 'SELL') THEN 'side' WHEN NOT price + 400 > 0 THEN 'price' WHEN NOT quantity BETWEEN 1 AND 2 THEN 'quantity'
  WHEN price + 400 < CASE symbol WHEN 'NQ' THEN 1000 ELSE 500 END THEN 'price_bounds' END AS rejected FROM fills) GROUP BY ALL""", (v.FILLS,))
def rejected_fills(spark, d):
    shifted = v.fills(spark, d).withColumn("price", F.col("price") + 400)
    return ct.implausible(shifted, max_quantity=2).groupBy("symbol", "rejected").agg(F.count("*").alias("n"))


REGIMED = "regimed AS (SELECT t.*, CAST(entry_time AS DATE) AS date, m.close, CASE WHEN m.close < 15 THEN 'Low' WHEN m.close <= 25 THEN 'Medium' ELSE 'High' END AS regime FROM trades t JOIN market m ON m.date = CAST(entry_time AS DATE))"


@query("volatility_cells", """SELECT symbol, dow, account_name, mean, low, medium, high, CASE WHEN low > 0 THEN greatest(low - coalesce(high, 0), 0) / low WHEN medium > 0 THEN greatest(medium - coalesce(high, 0), 0) / medium END AS fragility,
  coalesce(low > 0, true) AND coalesce(medium > 0, true) AND coalesce(high > 0, true) AS consistent, (low IS NOT NULL)::INTEGER + (medium IS NOT NULL)::INTEGER + (high IS NOT NULL)::INTEGER AS regimes FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, dow ORDER BY round(mean, 6) DESC, account_name) AS r FROM (
    SELECT symbol, dow, account_name, sum(t) / sum(n) AS mean, max(t / n) FILTER (regime = 'Low' AND n >= 3) AS low, max(t / n) FILTER (regime = 'Medium' AND n >= 3) AS medium, max(t / n) FILTER (regime = 'High' AND n >= 3) AS high FROM (
      SELECT symbol, dow, account_name, regime, count(*) AS n, sum(profit_loss) AS t FROM regimed GROUP BY ALL) GROUP BY ALL) WHERE coalesce(low, medium, high) IS NOT NULL) WHERE r = 1""", (v.TRADES, v.MARKET, REGIMED), "mean low medium high fragility")
def volatility_cells(spark, d):
    return vo.cells(v.trades(spark, d), v.market(spark, d), ["symbol", "dow"])


@query("volatility_heat_map", """SELECT hour, regime, n, mean, win_rate, mean - am AS mean_delta, win_rate - aw AS win_rate_delta FROM (SELECT hour, regime, count(*) AS n, avg(profit_loss) AS mean, count(*) FILTER (profit_loss > 0) / count(*) AS win_rate FROM regimed GROUP BY ALL),
  (SELECT avg(profit_loss) AS am, count(*) FILTER (profit_loss > 0) / count(*) AS aw FROM regimed)""", (v.TRADES, v.MARKET, REGIMED), "mean win_rate mean_delta win_rate_delta")
def volatility_heat_map(spark, d):
    return vo.heat_map(v.trades(spark, d), v.market(spark, d))


@query("volatility_correlation", "SELECT account_name, count(*) AS days, corr(close, pnl) AS correlation, regr_slope(pnl, close) AS slope, regr_intercept(pnl, close) AS intercept, regr_r2(pnl, close) AS r2 FROM days JOIN market USING (date) GROUP BY 1 HAVING count(*) >= 5", (v.TRADES, v.MARKET, DAYS), "correlation slope intercept r2")
def volatility_correlation(spark, d):
    return vo.correlation(v.trades(spark, d), v.market(spark, d))


@query("volatility_band", """SELECT account_name, (k * 2)::BIGINT AS band_low, n, mean FROM (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY round(mean, 6) DESC, k) AS r FROM (
  SELECT account_name, k, avg(profit_loss) AS mean, count(*) AS n FROM regimed JOIN range(0, 500) b(k) ON close >= 2 * k AND close < 2 * k + 4 GROUP BY ALL HAVING count(*) >= 5)) WHERE r = 1""", (v.TRADES, v.MARKET, REGIMED), "mean")
def volatility_band(spark, d):
    return vo.best_band(v.trades(spark, d), v.market(spark, d))


RULES = {
    "large_result": "abs(profit_loss) > 10000", "no_duration": "exit_time <= entry_time", "over_a_day": "epoch(exit_time) - epoch(entry_time) > 86400",
    "odd_hour": "NOT date_part('hour', entry_time) BETWEEN 6 AND 22", "weekend": "isodow(entry_time) >= 6", "no_quantity": "coalesce(quantity, 0) <= 0",
}


@query("import_checks", "SELECT account_name, rule, n, n / a AS share, CASE WHEN n = 0 THEN 'OK' WHEN n / a < 0.05 THEN 'WARNING' ELSE 'ERROR' END AS severity FROM (" + " UNION ALL ".join(f"SELECT account_name, '{k}' AS rule, count(*) FILTER ({r}) AS n, count(*) AS a FROM daily GROUP BY 1" for k, r in RULES.items()) + ")", (v.DAILY,), "share")
def import_checks(spark, d):
    return ck.broken(v.daily_trades(spark, d), ck.import_rules(), "account_name")


@query("field_errors", "SELECT error, count(*) AS n FROM (SELECT unnest([CASE WHEN side <> 'LONG' THEN 'side' END, CASE WHEN NOT quantity BETWEEN 1 AND 2 THEN 'quantity' END, CASE WHEN exit_time < entry_time THEN 'order_of_times' END]) AS error FROM trades) WHERE error IS NOT NULL GROUP BY 1", (v.TRADES,))
def field_errors(spark, d):
    checked = ck.validated(v.trades(spark, d), ck.field_rules(("LONG",), 2))
    return checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("pruned_trades", """SELECT reason, count(*) AS n, sum(profit_loss) AS total FROM (SELECT *, CASE WHEN CAST(entry_time AS DATE) < CAST(exit_time AS DATE) THEN 'multi_day' WHEN exit_time < entry_time THEN 'negative' WHEN trade_id > min(trade_id) OVER (PARTITION BY account_name, symbol, slot, side, quantity) THEN 'repeat' END AS reason FROM trades) GROUP BY 1""", (v.TRADES,), "total")
def pruned_trades(spark, d):
    p = ck.pruned(v.trades(spark, d), ["account_name", "symbol", "slot", "side", "quantity"], "trade_id")
    return p.groupBy("reason").agg(F.count("*").alias("n"), F.sum("profit_loss").alias("total"))


@query("symbol_catalogue", "SELECT symbol, count(*) AS n, count(DISTINCT account_name) AS accounts, min(entry_time) AS first_entry, max(entry_time) AS last_entry FROM trades GROUP BY 1", (v.TRADES,))
def symbol_catalogue(spark, d):
    return ck.catalogue(v.trades(spark, d))


@query("dataset_stats", "SELECT count(*) AS n, count(DISTINCT account_name) AS accounts, count(DISTINCT symbol) AS symbols, min(entry_time) AS first_entry, max(entry_time) AS last_entry, sum(profit_loss) AS total FROM trades", (v.TRADES,), "total")
def dataset_stats(spark, d):
    return ck.dataset_stats(v.trades(spark, d))


@query("sample_check", """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN k.trade_id IS NULL THEN 'missing' WHEN k.profit_loss = s.p AND k.entry_time = s.t THEN 'exact' WHEN abs(k.profit_loss - s.p) <= 0.01 AND abs(epoch(k.entry_time) - epoch(s.t)) <= 5 THEN 'close' ELSE 'different' END AS verdict
  FROM (SELECT trade_id, profit_loss + CASE WHEN trade_id % 5 = 0 THEN 1 ELSE 0 END AS p, entry_time + to_seconds(CASE WHEN trade_id % 3 = 0 THEN 4 ELSE 0 END) AS t FROM trades) s LEFT JOIN (SELECT * FROM trades WHERE trade_id % 7 <> 0) k USING (trade_id)) GROUP BY 1""", (v.TRADES,))
def sample_check(spark, d):
    t = v.trades(spark, d)
    late = F.make_dt_interval(secs=F.when(F.col("trade_id") % 3 == 0, 4).otherwise(0).cast("decimal(18,6)"))
    sample = t.withColumn("profit_loss", F.col("profit_loss") + F.when(F.col("trade_id") % 5 == 0, 1).otherwise(0)).withColumn("entry_time", F.col("entry_time") + late)
    return ck.compared(sample, t.filter("trade_id % 7 <> 0"), "trade_id").groupBy("verdict").agg(F.count("*").alias("n"))


@query("model_age", "SELECT account_name, e.date, max(t.date) AS trained, date_diff('day', max(t.date), e.date)::INTEGER AS age FROM days e LEFT JOIN (SELECT account_name, date FROM days WHERE date_part('day', date) % 7 = 1) t USING (account_name) WHERE t.date <= e.date OR t.date IS NULL GROUP BY account_name, e.date UNION ALL SELECT account_name, date, NULL, NULL FROM days d WHERE NOT EXISTS (SELECT 1 FROM days t WHERE t.account_name = d.account_name AND date_part('day', t.date) % 7 = 1 AND t.date <= d.date)", (v.TRADES, DAYS))
def model_age(spark, d):
    from ledgerloom.operators.market import daily

    days = daily(v.trades(spark, d)).select("account_name", "date")
    return ck.latest_before(days, days.filter(F.dayofmonth("date") % 7 == 1).withColumnRenamed("date", "trained"), "account_name", "date", "trained")


@query("gated_bins", """SELECT account_name, mean, oos_sharpe, oos_drop, coalesce(oos_sharpe > 0 AND oos_drop < greatest(3 * abs(mean), 500), false) AS passes FROM (SELECT account_name, avg(profit_loss) AS mean FROM trades GROUP BY 1) LEFT JOIN (
  SELECT account_name, max_by(profit_loss, trade_id) AS oos_sharpe, max_by(profit_loss * 10, trade_id) AS oos_drop FROM trades WHERE account_name <> 'ACC_2' GROUP BY 1) USING (account_name)""", (v.TRADES,), "mean oos_sharpe oos_drop")
def gated_bins(spark, d):
    t = v.trades(spark, d)
    results = t.filter("account_name <> 'ACC_2'").select("account_name", F.col("trade_id").alias("created"), F.col("trade_id").alias("result_id"), F.col("profit_loss").alias("sharpe"), (F.col("profit_loss") * 10).alias("max_drop"))
    return ck.gated(t.groupBy("account_name").agg(F.avg("profit_loss").alias("mean")), results, ["account_name"], "created")


PARENTS = """parents AS (SELECT account, symbol, parent_id, sum(quantity) FILTER (open_close = 'OPEN') AS o, sum(quantity) FILTER (open_close = 'CLOSE') AS c, sum(quantity * price) FILTER (open_close = 'OPEN') / sum(quantity) FILTER (open_close = 'OPEN') AS entry_price, sum(quantity * price) FILTER (open_close = 'CLOSE') / sum(quantity) FILTER (open_close = 'CLOSE') AS exit_price,
  min_by(side, ts) FILTER (open_close = 'OPEN') AS side, min(ts) FILTER (open_close = 'OPEN') AS entry_time, max(ts) FILTER (open_close = 'CLOSE') AS exit_time FROM orders_log GROUP BY ALL)"""


@query("parent_matches", "SELECT account, symbol, parent_id, CASE WHEN side = 'BUY' THEN 'LONG' ELSE 'SHORT' END AS direction, least(o, c)::BIGINT AS quantity, entry_time, exit_time, entry_price, exit_price, (exit_price - entry_price) * least(o, c) * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END - 4.2 * least(o, c) AS net FROM parents WHERE o > 0 AND c > 0", (v.ORDERS_LOG, PARENTS), "entry_price exit_price net")
def parent_matches(spark, d):
    return mc.by_parent(v.orders_log(spark, d))


@query("parent_leftovers", "SELECT account, symbol, count(*) AS n FROM partly ANTI JOIN (SELECT account, symbol, parent_id FROM partly GROUP BY ALL HAVING count(*) FILTER (open_close = 'OPEN') > 0 AND count(*) FILTER (open_close = 'CLOSE') > 0) USING (account, symbol, parent_id) GROUP BY ALL", (v.ORDERS_LOG, "partly AS (SELECT * FROM orders_log WHERE fill_id % 5 <> 0)"))
def parent_leftovers(spark, d):
    f = v.orders_log(spark, d).filter("fill_id % 5 <> 0")
    return mc.unmatched(f, mc.by_parent(f)).groupBy("account", "symbol").agg(F.count("*").alias("n"))


@query("order_matches", """SELECT account, symbol, date, count(*) AS orders, count(*) FILTER (b = s) AS matched, sum(CASE WHEN b = s THEN (sv - bv - 2.5) * b END) AS net FROM (SELECT account, symbol, CAST(ts AS DATE) AS date, parent_id, coalesce(sum(quantity) FILTER (side = 'BUY'), 0) AS b, coalesce(sum(quantity) FILTER (side = 'SELL'), 0) AS s,
  sum(quantity * price) FILTER (side = 'BUY') / sum(quantity) FILTER (side = 'BUY') AS bv, sum(quantity * price) FILTER (side = 'SELL') / sum(quantity) FILTER (side = 'SELL') AS sv FROM orders_log GROUP BY ALL) GROUP BY ALL""", (v.ORDERS_LOG,), "net")
def order_matches(spark, d):
    return mc.by_order(v.orders_log(spark, d)).groupBy("account", "symbol", "date").agg(F.count("*").alias("orders"), F.count_if("matched").alias("matched"), F.sum("net").alias("net"))


@query("split_fill_totals", "SELECT account_name, symbol, side, slot, dow, sum(quantity)::BIGINT AS quantity, sum(profit_loss) AS profit_loss, count(*) AS parts FROM trades GROUP BY ALL", (v.TRADES,), "profit_loss")
def split_fill_totals(spark, d):
    return mc.split_fills(v.trades(spark, d), ["account_name", "symbol", "side", "slot", "dow"], ["quantity", "profit_loss"])


@query("complete_books", "SELECT fill_id, account, symbol FROM clean SEMI JOIN (SELECT account, symbol, session FROM clean GROUP BY ALL HAVING sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) = 0) USING (account, symbol, session)", (v.FILLS, BOOKED))
def complete_books(spark, d):
    return mc.complete(_booked(spark, d)).select("fill_id", "account", "symbol")


_ROWS = "WINDOW w AS (PARTITION BY account_name, symbol ORDER BY entry_time, trade_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("rolling_features", f"""SELECT *, coalesce(roll_mean / nullif(roll_sigma, 0), 0) AS roll_sharpe FROM (SELECT trade_id, avg(profit_loss) OVER w AS roll_mean, coalesce(stddev_samp(profit_loss) OVER w, 0) AS roll_sigma, sum(profit_loss) OVER w AS roll_sum, min(profit_loss) OVER w AS roll_least, max(profit_loss) OVER w AS roll_largest,
  avg(CASE WHEN profit_loss > 0 THEN 1.0 ELSE 0.0 END) OVER w AS roll_win_rate FROM trades {_ROWS})""", (v.TRADES,), "roll_mean roll_sigma roll_sum roll_least roll_largest roll_win_rate roll_sharpe")
def rolling_features(spark, d):
    return ro.rolling(v.trades(spark, d), 10, "account_name", "symbol").select("trade_id", *[f"roll_{n}" for n in ("mean", "sigma", "sum", "least", "largest", "win_rate", "sharpe")])


@query("cumulative_features", """SELECT trade_id, cum_pnl, cum_wins, cum_wins / nth AS cum_rate, max(cum_pnl) OVER w - cum_pnl AS cum_drop FROM (SELECT *, sum(profit_loss) OVER w AS cum_pnl, (sum(CASE WHEN profit_loss > 0 THEN 1 ELSE 0 END) OVER w)::BIGINT AS cum_wins, count(*) OVER w AS nth FROM trades
  WINDOW w AS (PARTITION BY account_name ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY account_name ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING)""", (v.TRADES,), "cum_pnl cum_rate cum_drop")
def cumulative_features(spark, d):
    return ro.cumulative(v.trades(spark, d), "account_name").select("trade_id", "cum_pnl", "cum_wins", "cum_rate", "cum_drop")


@query("band_features", f"""SELECT trade_id, CASE WHEN k = 10 THEN m END AS sma, CASE WHEN k = 10 THEN m + 2 * s END AS upper, CASE WHEN k = 10 THEN m - 2 * s END AS lower, CASE WHEN k = 10 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi FROM (
  SELECT trade_id, count(*) OVER w AS k, avg(profit_loss) OVER w AS m, stddev_samp(profit_loss) OVER w AS s, avg(greatest(profit_loss, 0)) OVER w AS g, avg(greatest(-profit_loss, 0)) OVER w AS l FROM trades {_ROWS})""", (v.TRADES,), "sma upper lower rsi")
def band_features(spark, d):
    return ro.bands(v.trades(spark, d), 10, "account_name", "symbol").select("trade_id", "sma", "upper", "lower", "rsi")


@query("cyclic_features", "SELECT trade_id, sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos, sin(2 * pi() * dow / 7) AS dow_sin, cos(2 * pi() * dow / 7) AS dow_cos FROM trades", (v.TRADES,), "hour_sin hour_cos dow_sin dow_cos")
def cyclic_features(spark, d):
    return ro.cyclic(v.trades(spark, d)).select("trade_id", "hour_sin", "hour_cos", "dow_sin", "dow_cos")


@query("time_bin_metrics", """SELECT account_name, slot, count(*) AS n, avg(profit_loss) AS mean, count(*) FILTER (profit_loss > 0) / count(*) AS win_rate, sum(profit_loss) FILTER (profit_loss > 0) / nullif(abs(sum(profit_loss) FILTER (profit_loss < 0)), 0) AS profit_factor, 252 * avg(profit_loss) / nullif(stddev_samp(profit_loss) * sqrt(252), 0) AS sharpe, 252 * avg(profit_loss) / nullif(max(dd), 0) AS calmar,
  252 * avg(profit_loss) / nullif(stddev_samp(profit_loss) FILTER (profit_loss < 0) * sqrt(252), 0) AS sortino, max(dd) AS worst_drop FROM (SELECT *, max(e) OVER w - e AS dd FROM (SELECT *, sum(profit_loss) OVER w AS e FROM trades WINDOW w AS (PARTITION BY account_name, slot ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY account_name, slot ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2""", (v.TRADES,), "mean win_rate profit_factor sharpe calmar sortino worst_drop")
def time_bin_metrics(spark, d):
    return ro.bin_metrics(v.trades(spark, d), ["account_name", "slot"])


@query("capital_curve", """SELECT trade_id, account_name, equity, (greatest(max(equity) OVER w, 10000) - equity) / greatest(max(equity) OVER w, 10000) AS drop_share FROM (SELECT *, 10000 + sum(profit_loss - 2.5) OVER w AS equity FROM trades WINDOW w AS (PARTITION BY account_name ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING))
  WINDOW w AS (PARTITION BY account_name ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING)""", (v.TRADES,), "equity drop_share")
def capital_curve(spark, d):
    return ro.capital_curve(v.trades(spark, d), 10_000.0, 2.5, "account_name").select("trade_id", "account_name", "equity", "drop_share")


@query("snapshot_anomalies", f"""SELECT account_name, symbol, start, anomaly, n FROM (SELECT *, unnest([CASE WHEN abs(vz) > 2 THEN 'volume' END, CASE WHEN rz < -2 THEN 'degradation' END, CASE WHEN losing >= 3 THEN 'loss_streak' END]) AS anomaly FROM (
  SELECT *, count(*) OVER b AS known, (n - avg(n) OVER b) / nullif(stddev_samp(n) OVER b, 0) AS vz, (total - avg(total) OVER b) / nullif(stddev_samp(total) OVER b, 0) AS rz, sum(CASE WHEN total < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account_name, symbol ORDER BY start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS losing FROM ({SQL['snapshots'].split('result AS (', 1)[1].rsplit(') SELECT', 1)[0]})
  WINDOW b AS (PARTITION BY account_name, symbol ORDER BY start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE known >= 10) WHERE anomaly IS NOT NULL""", (v.TRADES,))
def snapshot_anomalies(spark, d):
    found = ro.anomalies(mo.snapshots(v.trades(spark, d)), "account_name", "symbol", z=2.0, losses=3)
    return found.select("account_name", "symbol", F.col("start").cast("timestamp_ntz").alias("start"), "anomaly", "n")


@query("degradation_tests", """SELECT account_name, n0 AS n_old, n1 AS n_new, (m1 - m0) / nullif(sqrt(v0 / n0 + v1 / n1), 0) AS t, (r1 - r0) / nullif(sqrt((r0 * n0 + r1 * n1) / (n0 + n1) * (1 - (r0 * n0 + r1 * n1) / (n0 + n1)) * (1 / n0 + 1 / n1)), 0) AS z_win_rate, v1 / nullif(v0, 0) AS variance_ratio FROM (
  SELECT account_name, count(*) FILTER (NOT r) AS n0, count(*) FILTER (r) AS n1, avg(profit_loss) FILTER (NOT r) AS m0, avg(profit_loss) FILTER (r) AS m1, var_samp(profit_loss) FILTER (NOT r) AS v0, var_samp(profit_loss) FILTER (r) AS v1, avg(CASE WHEN profit_loss > 0 THEN 1.0 ELSE 0.0 END) FILTER (NOT r) AS r0, avg(CASE WHEN profit_loss > 0 THEN 1.0 ELSE 0.0 END) FILTER (r) AS r1
  FROM (SELECT *, entry_time > (SELECT max(entry_time) FROM trades) - INTERVAL 7 DAY AS r FROM trades) GROUP BY 1) WHERE n0 >= 2 AND n1 >= 2""", (v.TRADES,), "t z_win_rate variance_ratio")
def degradation_tests(spark, d):
    return ro.degraded(v.trades(spark, d), "account_name")


@query("iqr_outliers", """SELECT trade_id, t.account_name, profit_loss FROM trades t JOIN (SELECT account_name, max(profit_loss) FILTER (r = floor(n * 0.25)) AS q1, max(profit_loss) FILTER (r = floor(n * 0.75)) AS q3 FROM (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY profit_loss, trade_id) - 1 AS r, count(*) OVER (PARTITION BY account_name) AS n FROM trades) GROUP BY 1) q USING (account_name)
  WHERE profit_loss < q1 - 0.5 * (q3 - q1) OR profit_loss > q3 + 0.5 * (q3 - q1)""", (v.TRADES,), "profit_loss")
def iqr_outliers(spark, d):
    return ro.iqr_outliers(v.trades(spark, d), "account_name", factor=0.5).select("trade_id", "account_name", "profit_loss")


@query("runs_test", """SELECT account_name, ups, downs, runs, (runs - (2.0 * ups * downs / (ups + downs) + 1)) / nullif(sqrt(2.0 * ups * downs * (2.0 * ups * downs - (ups + downs)) / ((ups + downs) * (ups + downs) * (ups + downs - 1))), 0) AS z FROM (
  SELECT account_name, count(*) FILTER (up) AS ups, count(*) FILTER (NOT up) AS downs, sum(f)::BIGINT AS runs FROM (SELECT account_name, pnl > 0 AS up, CASE WHEN (pnl > 0) = lag(pnl > 0) OVER (PARTITION BY account_name ORDER BY date) THEN 0 ELSE 1 END AS f FROM days) GROUP BY 1) WHERE ups > 0 AND downs > 0""", (v.DAILY, "days AS (SELECT account_name, CAST(entry_time AS DATE) AS date, sum(profit_loss) AS pnl FROM daily GROUP BY ALL)"), "z")
def runs_test(spark, d):
    return ro.runs_test(v.daily_trades(spark, d), "account_name")


_M = "m AS (SELECT {k}, count(*) AS n, avg(profit_loss) AS mean, stddev_samp(profit_loss) AS sigma FROM trades GROUP BY 1)"


@query("weekday_tests", """SELECT a.dow AS dow_a, b.dow AS dow_b, a.mean - b.mean AS difference, (a.mean - b.mean) / sqrt(a.sigma ** 2 / a.n + b.sigma ** 2 / b.n) AS t FROM m a JOIN m b ON a.dow < b.dow WHERE a.sigma > 0 AND b.sigma > 0 AND a.n >= 2 AND b.n >= 2""", (v.TRADES, _M.format(k="dow")), "difference t")
def weekday_tests(spark, d):
    return sg.welch(v.trades(spark, d), "dow").select("dow_a", "dow_b", "difference", "t")


@query("best_hours", "SELECT account_name, hour, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY round(total, 6) DESC, hour) AS rank FROM (SELECT account_name, hour, sum(profit_loss) AS total FROM trades GROUP BY ALL)) WHERE rank <= 3", (v.TRADES,), "total")
def best_hours(spark, d):
    from pyspark.sql import Window

    by = v.trades(spark, d).groupBy("account_name", "hour").agg(F.sum("profit_loss").alias("total"))
    rank = F.row_number().over(Window.partitionBy("account_name").orderBy(F.desc(F.round("total", 6)), "hour"))
    return by.withColumn("rank", rank).filter("rank <= 3")


@query("shifted_hours", "SELECT account_name, date_part('hour', exit_time - INTERVAL 5 HOUR)::INTEGER AS hour, count(*) AS n, sum(profit_loss) AS total, count(*) FILTER (profit_loss > 0) AS winners, count(*) FILTER (profit_loss < 0) AS losers, least(sum(profit_loss), 0) AS under FROM trades GROUP BY ALL", (v.TRADES,), "total under")
def shifted_hours(spark, d):
    at = F.hour(F.col("exit_time") - F.expr("INTERVAL 5 HOURS"))
    p = F.col("profit_loss")
    return v.trades(spark, d).groupBy("account_name", at.alias("hour")).agg(F.count("*").alias("n"), F.sum(p).alias("total"), F.count_if(p > 0).alias("winners"), F.count_if(p < 0).alias("losers"), F.least(F.sum(p), F.lit(0.0)).alias("under"))
