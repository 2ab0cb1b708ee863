"""Further queries of the catalogue, and their SQL: rank tests, variance, tails, resampling, strategies, positions, lasting alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import positions as po
from ledgerloom.operators import ranks as rk
from ledgerloom.operators import series as sr
from ledgerloom.operators import significance as sg
from ledgerloom.operators import simulate as sm
from ledgerloom.operators import strategies as st
from ledgerloom.streaming import monitor as mo

from . import views as v
from .catalog import BOOKED, DATED, PHI, RUN, T_WITHIN, _booked, paths_sql, query

DATED["position_ledger"] = "session"

_P = PHI.replace("{z}", "(-abs(z))")
_RANKED = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0 AS place, count(*) OVER (PARTITION BY {k}, {x}) AS ties"


@query("signed_rank_tests", f"""SELECT *, 2 * {_P} AS p FROM (SELECT account_name, symbol, n, w, (w - n * (n + 1) / 4) / sqrt(nullif(n * (n + 1) * (2 * n + 1) / 24 - t / 48, 0)) AS z FROM (
  SELECT account_name, symbol, count(*) AS n, coalesce(sum(place) FILTER (profit_loss > 0), 0) AS w, sum(ties * ties - 1.0) AS t FROM (
    SELECT *, {_RANKED.format(k='account_name, symbol', x='abs(profit_loss)')} FROM trades WHERE profit_loss <> 0) GROUP BY ALL))""", (v.TRADES,), "w z p")
def signed_rank_tests(spark, d):
    return rk.signed_rank(v.trades(spark, d), "account_name", "symbol")


@query("rank_sum_tests", f"""SELECT *, 2 * {_P} AS p FROM (SELECT symbol, n_first, n_other, u, (u - n_first * n_other / 2) / sqrt(nullif(n_first * n_other / 12 * (n + 1 - t / (n * (n - 1))), 0)) AS z FROM (
  SELECT symbol, count(*) FILTER (side = 'LONG') AS n_first, count(*) FILTER (side <> 'LONG') AS n_other, count(*) AS n, sum(place) FILTER (side = 'LONG') - n_first * (n_first + 1) / 2 AS u, sum(ties * ties - 1.0) AS t FROM (
    SELECT *, {_RANKED.format(k='symbol', x='profit_loss')} FROM trades) GROUP BY 1))""", (v.TRADES,), "u z p")
def rank_sum_tests(spark, d):
    return rk.rank_sum(v.trades(spark, d), F.col("side") == "LONG", "symbol")


@query("normality_tests", f"""SELECT symbol, n, mean, sigma, skew, excess, n / 6 * (skew * skew + excess * excess / 4) AS jarque_bera, exp(-n / 12 * (skew * skew + excess * excess / 4)) AS p, ks FROM (
  SELECT symbol, any_value(n) AS n, any_value(mean) AS mean, any_value(sigma) AS sigma, avg(pow(z, 3)) AS skew, avg(pow(z, 4)) - 3 AS excess, max(greatest(abs(hi / n - phi), abs(phi - (lo - 1) / n))) AS ks FROM (
    SELECT *, {PHI.replace('{z}', 'z')} AS phi FROM (SELECT *, (profit_loss - mean) / sigma AS z FROM (
      SELECT *, count(*) OVER (PARTITION BY symbol) AS n, avg(profit_loss) OVER (PARTITION BY symbol) AS mean, stddev_pop(profit_loss) OVER (PARTITION BY symbol) AS sigma,
        rank() OVER (PARTITION BY symbol ORDER BY profit_loss) AS lo, count(*) OVER (PARTITION BY symbol ORDER BY profit_loss) AS hi FROM trades))) GROUP BY 1)""", (v.TRADES,), "mean sigma skew excess jarque_bera p ks")
def normality_tests(spark, d):
    return rk.normality(v.trades(spark, d), "symbol")


@query("loss_tails", """SELECT account_name, n, var, beyond, var + m AS expected_shortfall, (1 - m * m / s2) / 2 AS shape, m * (1 + m * m / s2) / 2 AS scale FROM (
  SELECT account_name, any_value(n) AS n, any_value(var) AS var, count(*) FILTER (loss > var) AS beyond, avg(loss - var) FILTER (loss > var) AS m, nullif(var_samp(loss - var) FILTER (loss > var), 0) AS s2 FROM (
    SELECT *, min(loss) FILTER (hi >= 0.95 * n) OVER (PARTITION BY account_name) AS var FROM (
      SELECT account_name, -profit_loss AS loss, count(*) OVER (PARTITION BY account_name) AS n, count(*) OVER (PARTITION BY account_name ORDER BY -profit_loss) AS hi FROM trades)) GROUP BY 1) WHERE beyond > 0""", (v.TRADES,), "var expected_shortfall shape scale")
def loss_tails(spark, d):
    return rk.tails(v.trades(spark, d), "account_name")


@query("win_rate_tests", """SELECT account_name, hour, n, wins, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) for i in range(wins, n + 1)]) AS p FROM (
  SELECT account_name, hour, count(*) AS n, count(*) FILTER (profit_loss > 0) AS wins FROM trades GROUP BY ALL)""", (v.TRADES,), "p")
def win_rate_tests(spark, d):
    return sg.win_rate_test(v.trades(spark, d), "account_name", "hour")


_F_BELOW = """list_sum([(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 2 * pow(i * sqrt(f) / 2000, d1 - 1) *
  exp(lgamma((d1 + d2) / 2.0) - lgamma(d1 / 2.0) - lgamma(d2 / 2.0) + d1 / 2.0 * ln(d1 / d2) - (d1 + d2) / 2.0 * ln(1 + d1 / d2 * pow(i * sqrt(f) / 2000, 2))) for i in range(0, 2001)]) * sqrt(f) / 6000"""


@query("account_variance", f"""SELECT symbol, groups, n, f, 1 - {_F_BELOW} AS p FROM (SELECT *, between_sum / d1 / (within_sum / d2) AS f FROM (
  SELECT symbol, count(DISTINCT account_name) AS groups, count(*) AS n, (groups - 1)::DOUBLE AS d1, (n - groups)::DOUBLE AS d2, sum(pow(mean - grand, 2)) AS between_sum, sum(pow(profit_loss - mean, 2)) AS within_sum FROM (
    SELECT *, avg(profit_loss) OVER (PARTITION BY symbol, account_name) AS mean, avg(profit_loss) OVER (PARTITION BY symbol) AS grand FROM trades) GROUP BY 1))""", (v.TRADES,), "f p")
def account_variance(spark, d):
    return sg.one_way(v.trades(spark, d), "account_name", "symbol")


_WITHIN = T_WITHIN.replace("abs(t)", "((lo + hi) / 2)")


@query("mean_intervals", f"""SELECT account_name, symbol, n, mean, sigma, mean - lo * sigma / sqrt(n) AS low, mean + lo * sigma / sqrt(n) AS high FROM (WITH RECURSIVE halved AS (
  SELECT account_name, symbol, count(*) AS n, avg(profit_loss) AS mean, stddev_samp(profit_loss) AS sigma, n - 1 AS df, 0.0::DOUBLE AS lo, 16.0::DOUBLE AS hi, 0 AS turn FROM trades GROUP BY ALL HAVING count(*) >= 2 AND stddev_samp(profit_loss) > 0
  UNION ALL SELECT account_name, symbol, n, mean, sigma, df, CASE WHEN inside < 0.95 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN inside < 0.95 THEN hi ELSE (lo + hi) / 2 END, turn + 1 FROM (SELECT *, {_WITHIN} AS inside FROM halved WHERE turn < 45))
  SELECT * FROM halved WHERE turn = 45)""", (v.TRADES,), "mean sigma low high")
def mean_intervals(spark, d):
    return sg.intervals(v.trades(spark, d), "account_name", "symbol")


@query("month_stability", """SELECT account_name, count(*) AS pairs, corr(mean, later) AS persistence, regr_r2(later, mean) AS r2, avg(CASE WHEN sign(mean) = sign(later) THEN 1.0 ELSE 0.0 END) AS hit_ratio FROM (
  SELECT *, lead(mean) OVER (PARTITION BY account_name, symbol, slot ORDER BY month) AS later FROM (SELECT account_name, symbol, slot, strftime(entry_time, '%Y-%m') AS month, avg(profit_loss) AS mean FROM daily GROUP BY ALL)) WHERE later IS NOT NULL GROUP BY 1""", (v.DAILY,), "persistence r2 hit_ratio")
def month_stability(spark, d):
    return sg.month_stability(v.daily_trades(spark, d), "symbol", "slot")


@query("needed_trades", "SELECT account_name, symbol, n, mean / sigma AS effect, ceil(pow(2.801585 / (mean / sigma), 2))::BIGINT AS needed FROM (SELECT account_name, symbol, count(*) AS n, avg(profit_loss) AS mean, stddev_samp(profit_loss) AS sigma FROM trades GROUP BY ALL) WHERE n >= 2 AND sigma > 0 AND mean <> 0", (v.TRADES,), "effect")
def needed_trades(spark, d):
    return sg.needed_trades(v.trades(spark, d), "account_name", "symbol")


_FEATURES = ["hour", "dow", "quantity"]


@query("feature_scores", "SELECT *, correlation * correlation / nullif(1 - correlation * correlation, 0) * (n - 2) AS f FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, corr({x}, profit_loss) AS correlation, count(*) AS n FROM trades" for x in _FEATURES) + ")", (v.TRADES,), "correlation f")
def feature_scores(spark, d):
    return sg.feature_scores(v.trades(spark, d), _FEATURES, "profit_loss")


@query("block_paths", paths_sql(block=5), (v.TRADES,), "mean sigma p_loss mean_drop " + " ".join(f"p{q:02d}" for q in (1, 5, 10, 25, 50, 75, 90, 95, 99)))
def block_paths(spark, d):
    return sm.bootstrap(v.trades(spark, d), block=5)


@query("position_ledger", """WITH RECURSIVE n AS (SELECT fill_id, account, symbol, session, price, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS q, row_number() OVER (PARTITION BY account, symbol, session ORDER BY ts, fill_id) AS k FROM clean),
  walk AS (
    SELECT account, symbol, session, 0::BIGINT AS k, NULL::BIGINT AS fill_id, 0::BIGINT AS position, NULL::DOUBLE AS average_price, 0.0::DOUBLE AS realised FROM (SELECT DISTINCT account, symbol, session FROM n)
    UNION ALL
    SELECT n.account, n.symbol, n.session, n.k, n.fill_id, w.position + n.q,
      CASE WHEN w.position + n.q = 0 THEN NULL WHEN w.position = 0 THEN n.price WHEN sign(w.position) = sign(n.q) THEN (w.average_price * abs(w.position) + n.price * abs(n.q)) / (abs(w.position) + abs(n.q)) WHEN sign(w.position + n.q) = sign(w.position) THEN w.average_price ELSE n.price END,
      CASE WHEN sign(w.position) * sign(n.q) < 0 THEN least(abs(n.q), abs(w.position)) * (n.price - w.average_price) * sign(w.position) ELSE 0.0 END
    FROM walk w JOIN n ON n.account = w.account AND n.symbol = w.symbol AND n.session = w.session AND n.k = w.k + 1)
  SELECT fill_id, account, symbol, session, position, average_price, realised FROM walk WHERE k > 0""", (v.FILLS, BOOKED), "average_price realised")
def position_ledger(spark, d):
    return po.ledger(_booked(spark, d))


@query("rolling_drops", """SELECT trade_id, account_name, n_window, pnl_window, CASE WHEN sigma > 1e-9 THEN pnl_window / n_window / sigma * sqrt(252) END AS sharpe_window, drop_window FROM (
  SELECT trade_id, account_name, count(*) AS n_window, sum(p) AS pnl_window, stddev_samp(p) AS sigma, max(greatest(top, 0) - e) AS drop_window FROM (
    SELECT *, max(e) OVER (PARTITION BY trade_id ORDER BY x, i) AS top FROM (
      SELECT t.trade_id, t.account_name, u.profit_loss AS p, u.exit_time AS x, u.trade_id AS i, sum(u.profit_loss) OVER (PARTITION BY t.trade_id ORDER BY u.exit_time, u.trade_id) AS e
      FROM trades t JOIN trades u ON u.account_name = t.account_name AND u.exit_time >= t.exit_time - INTERVAL 3 DAY AND (u.exit_time < t.exit_time OR (u.exit_time = t.exit_time AND u.trade_id <= t.trade_id))))
  GROUP BY ALL HAVING count(*) >= 2)""", (v.TRADES,), "pnl_window sharpe_window drop_window")
def rolling_drops(spark, d):
    return sr.rolling_drops(v.trades(spark, d), 3, "account_name").select("trade_id", "account_name", "n_window", "pnl_window", "sharpe_window", "drop_window")


@query("fills_across_files", """SELECT file, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY account, symbol, side, quantity, price, note, round_even(epoch_us(ts) / 1e6 * 2, 0) ORDER BY file, ts, fill_id) AS r FROM copies) WHERE r = 1 GROUP BY 1""",
  (v.FILLS, "copies AS (SELECT *, 'log' || (fill_id % 3) AS file FROM fills UNION ALL SELECT *, 'log' || (fill_id % 5) AS file FROM fills WHERE fill_id % 2 = 0)"))
def fills_across_files(spark, d):
    f, name = v.fills(spark, d), lambda k: F.concat(F.lit("log"), (F.col("fill_id") % k).cast("string"))
    copies = f.withColumn("file", name(3)).unionByName(f.filter("fill_id % 2 = 0").withColumn("file", name(5)))
    return po.once_across_files(copies, "file").groupBy("file").agg(F.count("*").alias("n"))


CELL = ["account_name", "symbol", "slot"]
SAID = """said AS (SELECT account_name, symbol, slot, n, unnest(['statistical', 'persistence', 'likelihood']) AS strategy, unnest([least(greatest(t / 3, 0), 1), persistence, w / n]) AS confidence, unnest([t > 1, persistence >= 0.6, w / n > 0.5]) AS recommends FROM (
  SELECT account_name, symbol, slot, n, w, persistence, coalesce(mean / nullif(sigma / sqrt(n), 0), 0) AS t FROM (SELECT account_name, symbol, slot, count(*) AS n, count(*) FILTER (profit_loss > 0) AS w, avg(profit_loss) AS mean, stddev_samp(profit_loss) AS sigma FROM known GROUP BY ALL HAVING count(*) >= 5)
  JOIN (SELECT account_name, symbol, slot, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS persistence FROM (SELECT account_name, symbol, slot, strftime(entry_time, '%Y-%m'), sum(profit_loss) AS s FROM known GROUP BY ALL) GROUP BY ALL) USING (account_name, symbol, slot)))"""
BEFORE = "known AS (SELECT * FROM daily WHERE entry_time < TIMESTAMP '1997-01-01')"


def _said(spark, d):
    return st.verdicts(v.daily_trades(spark, d).filter("entry_time < timestamp_ntz'1997-01-01 00:00:00'"), CELL)


@query("strategy_votes", """SELECT *, weight >= 0.5 - 1e-9 AS chosen FROM (SELECT account_name, symbol, slot, sum(CASE WHEN recommends THEN x ELSE 0 END) AS weight, sum(x * confidence) AS confidence, count(*) FILTER (recommends) AS votes FROM (
  SELECT *, CASE strategy WHEN 'statistical' THEN 0.4 WHEN 'persistence' THEN 0.35 ELSE 0.25 END::DOUBLE AS x FROM said) GROUP BY ALL)""", (v.DAILY, BEFORE, SAID), "weight confidence")
def strategy_votes(spark, d):
    return st.vote(_said(spark, d), CELL)


@query("strategy_scores", """SELECT *, row_number() OVER (ORDER BY round(composite, 9) DESC, strategy)::INTEGER AS rank FROM (SELECT *, (accuracy + precision + recall + f1) / 4 AS composite FROM (
  SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (
    SELECT strategy, count(*) FILTER (recommends AND profit_loss > 0) AS tp, count(*) FILTER (recommends AND profit_loss <= 0) AS fp, count(*) FILTER (NOT recommends AND profit_loss > 0) AS fn, count(*) FILTER (NOT recommends AND profit_loss <= 0) AS tn
    FROM daily JOIN said USING (account_name, symbol, slot) WHERE entry_time >= TIMESTAMP '1997-01-01' GROUP BY 1)))""", (v.DAILY, BEFORE, SAID), "accuracy precision recall f1 composite")
def strategy_scores(spark, d):
    return st.evaluated(v.daily_trades(spark, d).filter("entry_time >= timestamp_ntz'1997-01-01 00:00:00'"), _said(spark, d), CELL)


_SNAPS = """snaps AS (SELECT start, account_name, count(*) AS n, count(*) FILTER (profit_loss > 0) / count(*) AS win_rate FROM (
  SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, entry_time) - k * INTERVAL 6 HOUR for k in [0, 1, 2, 3]]) AS start FROM trades) GROUP BY ALL)"""


@query("sustained_alerts", """SELECT account_name, min(start) AS since, max(start) AS until, count(*) AS snapshots, arg_max_null(later, start) AS resolved FROM (
  SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY account_name ORDER BY start) AS island FROM (
    SELECT *, win_rate < 0.6 AS bad, lead(start) OVER (PARTITION BY account_name ORDER BY start) AS later FROM snaps)) WHERE bad GROUP BY account_name, island HAVING max(start) >= min(start) + INTERVAL 12 HOUR""", (v.TRADES, _SNAPS))
def sustained_alerts(spark, d):
    snaps = mo.snapshots(v.trades(spark, d).withColumn("symbol", F.lit("all"))).withColumn("start", F.col("start").cast("timestamp_ntz"))
    return st.sustained(snaps, F.col("win_rate") < 0.6, "12 HOURS", "account_name")


@query("retained_trades", "SELECT account_name, count(*) AS n FROM trades WHERE entry_time >= (SELECT max(entry_time) FROM trades) - INTERVAL 168 HOUR GROUP BY 1", (v.TRADES,))
def retained_trades(spark, d):
    return st.retained(v.trades(spark, d), "entry_time", "168 HOURS").groupBy("account_name").agg(F.count("*").alias("n"))


@query("frozen_audit", """SELECT account_name, symbol, slot, expected, n, mean FROM (SELECT account_name, symbol, slot, avg(profit_loss) AS expected FROM known GROUP BY ALL HAVING count(*) >= 5 AND avg(profit_loss) > 0)
  JOIN (SELECT account_name, symbol, slot, count(*) AS n, avg(profit_loss) AS mean FROM daily WHERE entry_time >= TIMESTAMP '1997-01-01' GROUP BY ALL) USING (account_name, symbol, slot)""", (v.DAILY, BEFORE), "expected mean")
def frozen_audit(spark, d):
    return st.foreseen(v.daily_trades(spark, d), CELL, "1997-01-01 00:00:00")


_BINOMIAL = "list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) for i in range(wins, n + 1)])"


@query("significant_hours", f"""SELECT *, q <= 0.05 AND 2 * wins >= n AND mean > 0 AS selected FROM (SELECT account_name, symbol, hour, n, wins, mean, p, least(min(p * m / k) OVER (PARTITION BY account_name ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1.0) AS q FROM (
  SELECT *, count(*) OVER (PARTITION BY account_name) AS m, row_number() OVER (PARTITION BY account_name ORDER BY p, symbol, hour) AS k FROM (SELECT *, CASE WHEN wins = 0 THEN 1.0 ELSE {_BINOMIAL} END AS p FROM (
    SELECT account_name, symbol, hour, count(*) AS n, count(*) FILTER (profit_loss > 0) AS wins, avg(profit_loss) AS mean FROM trades GROUP BY ALL HAVING count(*) >= 10))))""", (v.TRADES,), "mean p q")
def significant_hours(spark, d):
    return st.significant(v.trades(spark, d), ["symbol", "hour"], min_trades=10)
