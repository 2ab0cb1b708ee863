"""Named queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import timeplane as tp
from ledgerloom.operators import fills as fl
from ledgerloom.operators import market as mk
from ledgerloom.operators import metrics as mt
from ledgerloom.operators import series as sr
from ledgerloom.operators import simulate as sm
from ledgerloom.operators import slots as sl
from ledgerloom.operators import significance as ts
from ledgerloom.operators import validation as vd
from ledgerloom.streaming import monitor as mo

from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
#: Queries as users run them, and the same rounded for the comparison with another engine.
QUERIES: dict[str, Query] = {}
COMPARED: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Date columns of queries.
DATED = {
    **dict.fromkeys(["clean_fills", "fifo_round_trips", "open_positions", "position_zero_trades", "sequence_check"], "session"),
    "market_regimes": "date since",
    "asof_close": "market_date",
    "rolling_correlation": "date",
}


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded for comparison, dates as text. The small shift keeps exact halves, which two engines may round apart,
    on one side."""
    shown = lambda c, t: F.round(F.col(c) + 1e-7, places) + F.lit(0.0) if t == "double" else F.col(c).cast("string") if t == "date" else F.col(c)
    return df.select(*[shown(c, t).alias(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = (), doubles: str = ""):
    """Registers a query. ``doubles`` names the columns that the SQL rounds as the DataFrame does; dates are known by name."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        COMPARED[name] = lambda spark, d: _rounded(f(spark, d))
        if sql:
            dates = [c for c in ("session", "date", "since", "market_date", "trained") if c in DATED.get(name, "").split()]
            replaced = ", ".join([f"round({c} + 1e-7, 4) + 0.0 AS {c}" for c in doubles.split()] + [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates])
            rounding = f" REPLACE ({replaced})" if replaced else ""
            SQL[name] = f"WITH {', '.join([*ctes, f'result AS ({sql})'])} SELECT *{rounding} FROM result"
        return f

    return add


PF99 = "CASE WHEN coalesce(abs(sum(profit_loss) FILTER (profit_loss <= 0)), 0) > 0 THEN coalesce(sum(profit_loss) FILTER (profit_loss > 0), 0) / abs(sum(profit_loss) FILTER (profit_loss <= 0)) ELSE {s} END"
STATS = f"""SELECT account_name, symbol, slot, dow, count(*) AS n, sum(profit_loss) AS total, avg(profit_loss) AS mean,
  100.0 * count(*) FILTER (profit_loss > 0) / count(*) AS win_rate, avg(profit_loss) FILTER (profit_loss > 0) AS avg_winner,
  avg(profit_loss) FILTER (profit_loss <= 0) AS avg_loser, max(profit_loss) AS best, min(profit_loss) AS worst,
  {PF99.format(s='99.0')} AS profit_factor, avg(profit_loss * profit_loss) AS mean_square
  FROM {{t}} GROUP BY ALL HAVING count(*) >= {{k}}"""
FRESH = "fresh AS (SELECT * FROM trades WHERE account_name IN (SELECT account_name FROM trades GROUP BY 1 HAVING max(entry_time) >= (SELECT max(entry_time) FROM trades) - INTERVAL 30 DAY))"


@query("slot_matrix", f"""SELECT account_name, symbol, slot, dow, n, total, mean, win_rate, avg_winner, avg_loser, best, worst, profit_factor, mean_square
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, slot, dow ORDER BY mean DESC, win_rate DESC, account_name) AS r FROM ({STATS.format(t="fresh", k=3)}))
  WHERE r = 1 AND mean > 0 AND win_rate >= 0""", (v.TRADES, FRESH), "total mean win_rate avg_winner avg_loser best worst profit_factor mean_square")
def slot_matrix(spark, d):
    return sl.slot_matrix(v.trades(spark, d))


@query("slot_matrix_filter_first", f"""SELECT account_name, symbol, slot, dow, n, total, mean, win_rate, avg_winner, avg_loser, best, worst, profit_factor, mean_square
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, slot, dow ORDER BY mean DESC, win_rate DESC, account_name) AS r FROM ({STATS.format(t="fresh", k=3)}) WHERE mean > 0 AND win_rate >= 50)
  WHERE r = 1""", (v.TRADES, FRESH), "total mean win_rate avg_winner avg_loser best worst profit_factor mean_square")
def slot_matrix_filter_first(spark, d):
    return sl.slot_matrix(v.trades(spark, d), min_win_rate=50.0, filter_first=True)


@query("slot_stats", STATS.format(t="trades", k=3), (v.TRADES,), "total mean win_rate avg_winner avg_loser best worst profit_factor mean_square")
def slot_stats(spark, d):
    return sl.slot_stats(v.trades(spark, d))


#: The normal distribution as in functions.stats.
PHI = "(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)".replace("{tail}", "exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))").replace("{t}", "(1 / (1 + 0.2316419 * abs({z})))")


@query("slot_reliability", f"""SELECT account_name, symbol, slot, dow, n, CASE WHEN n < 3 OR mean <= 0 THEN 0.0 ELSE 100 * {PHI.replace('{z}', 'z')} END AS reliability
  FROM (SELECT *, mean / (sqrt(greatest(mean_square - mean * mean, 1e-4)) / sqrt(n)) AS z FROM ({STATS.format(t="trades", k=3)}))""", (v.TRADES,), "reliability")
def slot_reliability(spark, d):
    s = sl.slot_stats(v.trades(spark, d))
    return s.select("account_name", "symbol", "slot", "dow", "n", sl.reliability(F.col("mean"), F.col("mean_square"), F.col("n")).alias("reliability"))


PERSISTENCE = """SELECT account_name, slot, count(*) AS months, count(*) FILTER (pnl > 0) AS good_months, 100.0 * count(*) FILTER (pnl > 0) / count(*) AS persistence, sum(pnl) AS total, sum(n)::BIGINT AS n,
  CASE WHEN coalesce(abs(sum(pnl) FILTER (pnl <= 0)), 0) > 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl <= 0)) ELSE 99.0 END AS monthly_profit_factor
  FROM (SELECT account_name, slot, strftime(entry_time, '%Y-%m') AS month, sum(profit_loss) AS pnl, count(*) AS n FROM daily GROUP BY ALL) GROUP BY ALL"""


@query("monthly_persistence", PERSISTENCE, (v.DAILY,), "persistence total monthly_profit_factor")
def monthly_persistence(spark, d):
    return sl.monthly_persistence(v.daily_trades(spark, d))


@query("discovery_leaders", f"""SELECT account_name, slot, months, good_months, persistence, total, n, monthly_profit_factor,
  concat_ws('+', CASE WHEN a = 1 THEN 'persistence' END, CASE WHEN b = 1 THEN 'profit' END, CASE WHEN c = 1 THEN 'volume' END) AS tags
  FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY persistence DESC, account_name) AS a, row_number() OVER (PARTITION BY slot ORDER BY total DESC, account_name) AS b, row_number() OVER (PARTITION BY slot ORDER BY n DESC, account_name) AS c FROM ({PERSISTENCE}))
  WHERE a = 1 OR b = 1 OR c = 1""", (v.DAILY,), "persistence total monthly_profit_factor")
def discovery_leaders(spark, d):
    return sl.leaders(sl.monthly_persistence(v.daily_trades(spark, d)))


@query("rolling_vote", """SELECT symbol, slot, dow, account_name, votes, share, CASE WHEN share >= 0.75 THEN 'High' WHEN share >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, slot, dow ORDER BY votes DESC, account_name) AS r FROM (
    SELECT *, votes / sum(votes) OVER (PARTITION BY symbol, slot, dow) AS share FROM (
      SELECT symbol, slot, dow, account_name, count(*) AS votes FROM (
        SELECT *, row_number() OVER (PARTITION BY w, symbol, slot, dow ORDER BY score DESC, account_name) AS k FROM (
          SELECT w, account_name, symbol, slot, dow, sum(profit_loss * pow(0.85, ago)) / sum(pow(0.85, ago)) AS score FROM (
            SELECT *, floor(date_diff('day', CAST(entry_time AS DATE), CAST((SELECT max(entry_time) FROM trades) AS DATE)) / 7) AS ago FROM trades), (SELECT unnest([1, 2, 4]) AS w)
          WHERE ago < w GROUP BY ALL HAVING count(*) >= 3)) WHERE k = 1 GROUP BY ALL))) WHERE r = 1""", (v.TRADES,), "share")
def rolling_vote(spark, d):
    return sl.rolling_vote(v.trades(spark, d))


@query("slot_grid", """SELECT account_name, slot, n, total FROM (SELECT DISTINCT account_name FROM trades)
  CROSS JOIN (SELECT lpad((i // 2)::VARCHAR, 2, '0') || CASE WHEN i % 2 = 0 THEN ':00' ELSE ':30' END AS slot FROM range(48) t(i))
  LEFT JOIN (SELECT account_name, slot, count(*) AS n, sum(profit_loss) AS total FROM trades GROUP BY ALL) USING (account_name, slot)""", (v.TRADES,), "total")
def slot_grid(spark, d):
    s = v.trades(spark, d).groupBy("account_name", "slot").agg(F.count("*").alias("n"), F.sum("profit_loss").alias("total"))
    return sl.slot_grid(s)


@query("account_summary", """SELECT account_name, count(*) AS n, count(*) FILTER (profit_loss > 0) AS wins, count(*) FILTER (profit_loss <= 0) AS losses, sum(profit_loss) AS total,
  avg(profit_loss) FILTER (profit_loss > 0) AS avg_win, avg(profit_loss) FILTER (profit_loss <= 0) AS avg_loss, max(profit_loss) AS best, min(profit_loss) AS worst,
  stddev_pop(profit_loss) AS volatility, avg((floor(epoch(exit_time)) - floor(epoch(entry_time))) / 60) AS avg_minutes, min(entry_time) AS first_entry, max(entry_time) AS last_entry FROM trades GROUP BY 1""", (v.TRADES,), "total avg_win avg_loss best worst volatility avg_minutes")
def account_summary(spark, d):
    return mt.account_summary(v.trades(spark, d))


@query("full_metrics", f"""SELECT account_name, symbol, count(*) AS n, w AS win_rate, pf AS profit_factor, sharpe, win / nullif(loss, 0) AS win_loss_ratio, w * win - (1 - w) * loss AS expectancy, coalesce(w > 0.55 AND win / nullif(loss, 0) < 1, false) AS risk_flag
  FROM (SELECT account_name, symbol, count(*) AS count, count(*) FILTER (profit_loss > 0) / count(*) AS w, {PF99.format(s='999.0')} AS pf, avg(profit_loss) / nullif(stddev_samp(profit_loss), 0) AS sharpe, avg(profit_loss) FILTER (profit_loss > 0) AS win, abs(avg(profit_loss) FILTER (profit_loss <= 0)) AS loss FROM trades GROUP BY ALL) x
  JOIN (SELECT account_name, symbol FROM trades) USING (account_name, symbol) GROUP BY ALL""", (v.TRADES,), "win_rate profit_factor sharpe win_loss_ratio expectancy")
def full_metrics(spark, d):
    return mt.full_metrics(v.trades(spark, d))


@query("daily_ratios", """SELECT account_name, count(*) AS days, avg(d) / nullif(stddev_pop(d), 0) * sqrt(252) AS sharpe,
  CASE WHEN sqrt(sum(CASE WHEN d < 0 THEN d * d ELSE 0 END) / count(*)) > 0 THEN avg(d) / sqrt(sum(CASE WHEN d < 0 THEN d * d ELSE 0 END) / count(*)) * sqrt(252) ELSE 99.9 END AS sortino
  FROM (SELECT account_name, CAST(entry_time AS DATE) AS day, sum(profit_loss) AS d FROM trades GROUP BY ALL) GROUP BY 1""", (v.TRADES,), "sharpe sortino")
def daily_ratios(spark, d):
    return mt.daily_ratios(v.trades(spark, d))


@query("sortino_ranking", """SELECT account_name, symbol, n, mean / sigma * sqrt(n / span * 252) AS sortino, n / span * 5 AS per_week FROM (
  SELECT account_name, symbol, count(*) AS n, avg(profit_loss) AS mean, count(*) FILTER (profit_loss < 0) AS losses, stddev_pop(profit_loss) FILTER (profit_loss < 0) AS sigma, greatest(date_diff('day', CAST(min(entry_time) AS DATE), CAST(max(entry_time) AS DATE)), 1) AS span FROM trades GROUP BY ALL)
  WHERE losses > 1 AND sigma > 0 ORDER BY sortino DESC, per_week DESC, account_name, symbol LIMIT 10""", (v.TRADES,), "sortino per_week")
def sortino_ranking(spark, d):
    return mt.sortino_ranking(v.trades(spark, d))


CHANCES = """SELECT account_name, symbol, dow, count(*) AS n, avg(x) AS mean, var_pop(x) AS variance,
  CASE WHEN var_pop(x) > 0 THEN (avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * pow(avg(x), 3)) / pow(var_pop(x), 1.5) END AS skew,
  CASE WHEN var_pop(x) > 0 THEN (avg(pow(x, 4)) - 4 * avg(x) * avg(x * x * x) + 6 * pow(avg(x), 2) * avg(x * x) - 3 * pow(avg(x), 4)) / pow(var_pop(x), 2) - 3 END AS kurtosis,
  count(*) FILTER (x > 0) / count(*) AS p_gain, count(*) FILTER (x > 50) / count(*) AS p_50, count(*) FILTER (x > 100) / count(*) AS p_100,
  list_sum(list_sort(list(x))[1 : greatest(floor(count(*) * 0.05), 1)::INTEGER]) / greatest(floor(count(*) * 0.05), 1) AS cvar,
  list_sort(list(x))[floor(count(*) * 0.25)::INTEGER + 1] AS q25, list_sort(list(x))[floor(count(*) * 0.75)::INTEGER + 1] AS q75, avg(x) * count(*) FILTER (x > 0) / count(*) AS cwev
  FROM (SELECT *, profit_loss AS x FROM trades) GROUP BY ALL HAVING count(*) >= 5"""
_MEASURES = "mean variance skew kurtosis p_gain p_50 p_100 cvar q25 q75 cwev"


@query("probability_matrix", CHANCES, (v.TRADES,), _MEASURES)
def probability_matrix(spark, d):
    return mt.probability_matrix(v.trades(spark, d), ["symbol", "dow", "account_name"]).select("account_name", "symbol", "dow", "n", *_MEASURES.split())


@query("probability_best", f"SELECT account_name, symbol, dow, n, cwev, p_gain FROM (SELECT *, row_number() OVER (PARTITION BY symbol, dow ORDER BY round(cwev, 6) DESC, account_name) AS r FROM ({CHANCES})) WHERE r = 1", (v.TRADES,), "cwev p_gain")
def probability_best(spark, d):
    cells = mt.probability_matrix(v.trades(spark, d), ["symbol", "dow", "account_name"])
    return mt.likeliest(cells, ["symbol", "dow"]).select("account_name", "symbol", "dow", "n", "cwev", "p_gain")


@query("risk_metrics", """SELECT account_name, var, avg(profit_loss) FILTER (profit_loss <= var) AS shortfall,
  greatest(least(count(*) FILTER (profit_loss > 0) / count(*) - (1 - count(*) FILTER (profit_loss > 0) / count(*)) / (avg(profit_loss) FILTER (profit_loss > 0) / nullif(abs(avg(profit_loss) FILTER (profit_loss <= 0)), 0)), 0.25), -0.25) AS kelly,
  count(*) FILTER (profit_loss < 0) / count(*) AS p_loss, avg(profit_loss) / nullif(sqrt(sum(CASE WHEN profit_loss < 0 THEN profit_loss * profit_loss ELSE 0 END) / count(*)), 0) * sqrt(count(*) / greatest(date_diff('day', min(entry_time), max(entry_time)), 1) * 252) AS sortino
  FROM trades JOIN (SELECT account_name, list_sort(list(profit_loss))[floor(0.05 * count(*) + 1e-9)::INTEGER + 1] AS var FROM trades GROUP BY 1) USING (account_name) GROUP BY ALL""", (v.TRADES,), "var shortfall kelly p_loss sortino")
def risk_metrics(spark, d):
    return mt.risk(v.trades(spark, d))


@query("outlier_trades", """SELECT trade_id, account_name, profit_loss, z FROM (
  SELECT *, CASE WHEN profit_loss > 0 THEN (profit_loss - mw) / nullif(sw, 0) WHEN profit_loss < 0 THEN (profit_loss - ml) / nullif(sl, 0) END AS z FROM trades JOIN (
    SELECT account_name, avg(profit_loss) FILTER (profit_loss > 0) AS mw, stddev_pop(profit_loss) FILTER (profit_loss > 0) AS sw, avg(profit_loss) FILTER (profit_loss < 0) AS ml, stddev_pop(profit_loss) FILTER (profit_loss < 0) AS sl
    FROM trades GROUP BY 1 HAVING count(*) >= 10 AND count(*) FILTER (profit_loss > 0) >= 5 AND count(*) FILTER (profit_loss < 0) >= 5) USING (account_name))
  WHERE (profit_loss > 0 AND z > 2) OR (profit_loss < 0 AND abs(z) > 3)""", (v.TRADES,), "profit_loss z")
def outlier_trades(spark, d):
    return mt.outliers(v.trades(spark, d)).select("trade_id", "account_name", "profit_loss", "z")


@query("monthly_pivot", "SELECT account_name, date_part('year', exit_time)::INTEGER AS year, " + ", ".join(f"sum(CASE WHEN date_part('month', exit_time) = {i} THEN profit_loss ELSE 0 END) AS m{i:02d}" for i in range(1, 13)) + " FROM daily GROUP BY ALL", (v.DAILY,), " ".join(f"m{i:02d}" for i in range(1, 13)))
def monthly_pivot(spark, d):
    return mt.monthly_pivot(v.daily_trades(spark, d))


@query("hour_or_weekday", "SELECT account_name, hour, dow, count(*) AS n, sum(profit_loss) AS total, avg(profit_loss) AS mean FROM trades GROUP BY GROUPING SETS ((account_name, hour), (account_name, dow))", (v.TRADES,), "total mean")
def hour_or_weekday(spark, d):
    return mt.hour_or_weekday(v.trades(spark, d))


@query("cube_side_symbol", "SELECT side, symbol, count(*) AS n, sum(profit_loss) AS total, (2 * grouping(side) + grouping(symbol))::BIGINT AS level FROM trades GROUP BY CUBE (side, symbol)", (v.TRADES,), "total")
def cube_side_symbol(spark, d):
    return mt.cube(v.trades(spark, d), "side", "symbol")


@query("quality_scores", """SELECT *, 0.3 * completeness + 0.3 * accuracy + 0.2 * consistency + 0.2 * uniqueness AS score FROM (
  SELECT account_name, count(*) AS n, 100.0 * count(*) FILTER (entry_time IS NOT NULL AND exit_time IS NOT NULL AND profit_loss IS NOT NULL) / count(*) AS completeness, 100.0 * count(*) FILTER (abs(profit_loss) <= 10000 AND quantity > 0) / count(*) AS accuracy,
  100.0 * count(*) FILTER (exit_time >= entry_time) / count(*) AS consistency, 100.0 * count(DISTINCT (symbol, entry_time, exit_time, profit_loss)) / count(*) AS uniqueness FROM daily GROUP BY 1)""", (v.DAILY,), "completeness accuracy consistency uniqueness score")
def quality_scores(spark, d):
    return mt.quality_scores(v.daily_trades(spark, d))


@query("duplicate_lines", "SELECT l_orderkey, l_linenumber, count(*) AS copies, count(*) - 1 AS extra FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_lines(spark, d):
    return mt.duplicates(v.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("concentration", """SELECT account_name, symbol, share, sum(share * share) OVER (PARTITION BY account_name) AS hhi FROM (
  SELECT account_name, symbol, size / nullif(sum(size) OVER (PARTITION BY account_name), 0) AS share FROM (SELECT account_name, symbol, abs(sum(profit_loss)) AS size FROM trades GROUP BY ALL))""", (v.TRADES,), "share hhi")
def concentration(spark, d):
    return mt.concentration(v.trades(spark, d))


DRAW = """SELECT *, greatest(max(equity) OVER w, 0) AS peak FROM (SELECT *, sum(profit_loss) OVER (PARTITION BY account_name ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING) AS equity FROM trades) WINDOW w AS (PARTITION BY account_name ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING)"""


@query("drawdown", f"SELECT trade_id, account_name, equity, peak, peak - equity AS drawdown FROM ({DRAW})", (v.TRADES,), "equity peak drawdown")
def drawdown(spark, d):
    return sr.drawdown(v.trades(spark, d), "account_name").select("trade_id", "account_name", "equity", "peak", "drawdown")


@query("drawdown_periods", f"""SELECT account_name, island, min(entry_time) AS start, max(peak - equity) AS depth, count(*) AS n, NOT bool_or(island = last) AS recovered FROM (
  SELECT *, max(island) OVER (PARTITION BY account_name) AS last FROM (
    SELECT *, (sum(np) OVER (PARTITION BY account_name ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM (
      SELECT *, CASE WHEN peak > coalesce(lag(peak) OVER (PARTITION BY account_name ORDER BY entry_time, trade_id), 0) THEN 1 ELSE 0 END AS np FROM ({DRAW}))))
  WHERE peak - equity > 0 GROUP BY account_name, island""", (v.TRADES,), "depth")
def drawdown_periods(spark, d):
    return sr.drawdown_periods(v.trades(spark, d), "account_name")


@query("rolling_days", "SELECT trade_id, account_name, count(*) OVER w AS n_window, sum(profit_loss) OVER w AS pnl_window FROM trades WINDOW w AS (PARTITION BY account_name ORDER BY exit_time RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW)", (v.TRADES,), "pnl_window")
def rolling_days(spark, d):
    return sr.rolling_days(v.trades(spark, d), 3, "account_name").select("trade_id", "account_name", "n_window", "pnl_window")


@query("streaks", """SELECT account_name, max(n) FILTER (win) AS longest_win, max(n) FILTER (NOT win) AS longest_loss, count(*) AS runs FROM (SELECT account_name, run, win, count(*) AS n FROM (
  SELECT *, sum(f) OVER (PARTITION BY account_name ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, profit_loss > 0 AS win, CASE WHEN (profit_loss > 0) = lag(profit_loss > 0) OVER (PARTITION BY account_name ORDER BY entry_time, trade_id) THEN 0 ELSE 1 END AS f FROM trades)) GROUP BY ALL) GROUP BY 1""", (v.TRADES,))
def streaks(spark, d):
    return sr.streaks(v.trades(spark, d), "account_name")


@query("lag_features", """SELECT trade_id, lag(profit_loss) OVER w AS prev, profit_loss - lag(profit_loss) OVER w AS change, row_number() OVER (PARTITION BY account_name, CAST(entry_time AS DATE) ORDER BY entry_time, trade_id)::INTEGER AS nth_today,
  avg(profit_loss) OVER (PARTITION BY account_name ORDER BY entry_time, trade_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean5 FROM trades WINDOW w AS (PARTITION BY account_name ORDER BY entry_time, trade_id)""", (v.TRADES,), "prev change mean5")
def lag_features(spark, d):
    return sr.features(v.trades(spark, d), "account_name").select("trade_id", "prev", "change", "nth_today", "mean5")


REGIMES = """SELECT date, close, regime, min(date) OVER (PARTITION BY island) AS since, date_diff('day', min(date) OVER (PARTITION BY island), date)::INTEGER AS days FROM (
  SELECT *, sum(f) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN regime = lag(regime) OVER (ORDER BY date) THEN 0 ELSE 1 END AS f FROM (
    SELECT *, CASE WHEN close < 15 THEN 'Low' WHEN close <= 25 THEN 'Medium' ELSE 'High' END AS regime FROM market)))"""


@query("market_regimes", REGIMES, (v.MARKET,), "close")
def market_regimes(spark, d):
    return sr.regimes(v.market(spark, d))


@query("regime_transitions", f"SELECT regime, to_regime, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM (SELECT regime, lead(regime) OVER (ORDER BY date) AS to_regime FROM ({REGIMES})) WHERE to_regime IS NOT NULL GROUP BY ALL", (v.MARKET,), "share")
def regime_transitions(spark, d):
    return sr.regime_transitions(v.market(spark, d))


@query("asof_close", """SELECT trade_id, close, market_date FROM (SELECT trade_id, CAST(entry_time AS DATE) AS day FROM trades) t LEFT JOIN (
  SELECT d.day, max_by(close, date) AS close, max(date) AS market_date FROM (SELECT DISTINCT CAST(entry_time AS DATE) AS day FROM trades) d JOIN market ON date <= d.day AND date >= d.day - 3 GROUP BY 1) m USING (day)""", (v.TRADES, v.MARKET), "close")
def asof_close(spark, d):
    return mk.asof_close(v.trades(spark, d), v.market(spark, d)).select("trade_id", "close", "market_date")


@query("filled_close", "SELECT trade_id, last_value(m.close IGNORE NULLS) OVER (PARTITION BY account_name ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING) AS close FROM trades LEFT JOIN market m ON m.date = CAST(entry_time AS DATE)", (v.TRADES, v.MARKET), "close")
def filled_close(spark, d):
    return mk.filled_close(v.trades(spark, d), v.market(spark, d), "account_name").select("trade_id", "close")


DAYS = "days AS (SELECT account_name, CAST(entry_time AS DATE) AS date, sum(profit_loss) AS pnl FROM trades GROUP BY ALL)"


@query("account_correlations", "SELECT a.account_name AS a, b.account_name AS b, count(*) AS days, corr(a.pnl, b.pnl) AS correlation FROM days a JOIN days b ON a.date = b.date AND a.account_name < b.account_name GROUP BY ALL HAVING count(*) >= 5", (v.TRADES, DAYS), "correlation")
def account_correlations(spark, d):
    return mk.account_correlations(v.trades(spark, d))


@query("market_beta", "SELECT account_name, count(*) AS days, regr_slope(pnl, ret) AS beta, regr_intercept(pnl, ret) AS alpha, regr_r2(pnl, ret) AS r2 FROM days JOIN (SELECT date, (close / lag(close) OVER (ORDER BY date) - 1) * 100 AS ret FROM market) USING (date) WHERE ret IS NOT NULL GROUP BY 1", (v.TRADES, v.MARKET, DAYS), "beta alpha r2")
def market_beta(spark, d):
    return mk.beta(v.trades(spark, d), v.market(spark, d))


@query("band_matches", """SELECT fill_id, m.r_id AS r_id, m.gap AS gap, candidates FROM (SELECT l.fill_id, min({'gap': abs(floor(epoch(l.ts)) - floor(epoch(r.ts)))::BIGINT, 'd': abs(l.price - r.price), 'r_id': r.fill_id}) AS m, count(*) AS candidates
  FROM fills l JOIN fills r ON l.account = r.account AND l.side = 'BUY' AND r.side = 'SELL' AND abs(floor(epoch(l.ts)) - floor(epoch(r.ts))) <= 3600 AND abs(l.price - r.price) <= 2 GROUP BY 1)""", (v.FILLS,))
def band_matches(spark, d):
    f = v.fills(spark, d)
    return mk.band_matches(f.filter("side = 'BUY'"), f.filter("side = 'SELL'"), seconds=3600)


def _booked(spark, d):
    f = v.fills(spark, d)
    local = tp.new_york(F.col("ts"))
    return fl.engine(f, local, tp.session_date(local))


def booked_sql(fills: str = "fills", by: str = "account, symbol", extra: str = "", tagged: str = "") -> str:
    """The chain of fills for DuckDB: the closes at flat positions of books with ghosts are found by a walk, fill by fill."""
    return f"""marked AS (
  SELECT *, CAST(ny + INTERVAL 7 HOUR AS DATE) AS session, quantity > 1 AND NOT (date_part('hour', ny) * 60 + date_part('minute', ny) BETWEEN 1015 AND 1025) AND open_close <> 'CLOSE' AND NOT regexp_matches(note, '[A-Za-z0-9]') {tagged}
      AND NOT (avg(CASE WHEN trim(note) <> '' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY {by}) < 0.25 AND count(*) OVER (PARTITION BY {by}) > 5) AS is_ghost
    FROM (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS ny FROM {fills} WHERE price > 0 AND quantity BETWEEN 1 AND 50)),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, symbol, side, quantity, price, round_even(epoch_us(ts) / 1e6 * 4, 0) {extra} ORDER BY CASE WHEN note <> '' THEN 0 ELSE 1 END, ts, fill_id) AS dup FROM marked WHERE NOT is_ghost) WHERE dup = 1),
  clean AS (WITH RECURSIVE n AS (SELECT fill_id, account, symbol, session, open_close = 'CLOSE' AS closes, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS q, row_number() OVER (PARTITION BY account, symbol, session ORDER BY ts, fill_id) AS k
      FROM kept SEMI JOIN (SELECT account, symbol, session FROM marked WHERE is_ghost) USING (account, symbol, session)),
    walk AS (
      SELECT account, symbol, session, 0::BIGINT AS k, 0::BIGINT AS position, NULL::BIGINT AS fill_id, false AS gone FROM (SELECT DISTINCT account, symbol, session FROM n)
      UNION ALL
      SELECT n.account, n.symbol, n.session, n.k, CASE WHEN w.position = 0 AND n.closes THEN 0 ELSE w.position + n.q END, n.fill_id, w.position = 0 AND n.closes
      FROM walk w JOIN n ON n.account = w.account AND n.symbol = w.symbol AND n.session = w.session AND n.k = w.k + 1)
    SELECT * FROM kept WHERE fill_id NOT IN (SELECT fill_id FROM walk WHERE gone))"""


BOOKED = booked_sql()


@query("clean_fills", "SELECT fill_id, account, symbol, session, side, quantity, price FROM clean", (v.FILLS, BOOKED), "price")
def clean_fills(spark, d):
    return _booked(spark, d).select("fill_id", "account", "symbol", "session", "side", "quantity", "price")


@query("fifo_round_trips", """SELECT account, symbol, session, CASE WHEN long THEN 'LONG' ELSE 'SHORT' END AS direction, (hi - lo)::BIGINT AS quantity, CASE WHEN long THEN b_ts ELSE s_ts END AS entry_time, CASE WHEN long THEN s_ts ELSE b_ts END AS exit_time,
  CASE WHEN long THEN b_price ELSE s_price END AS entry_price, CASE WHEN long THEN s_price ELSE b_price END AS exit_price, (s_price - b_price) * (hi - lo) AS points
  FROM (SELECT b.account, b.symbol, b.session, greatest(b.hi - b.quantity, s.hi - s.quantity) AS lo, least(b.hi, s.hi) AS hi, b.ts AS b_ts, s.ts AS s_ts, b.price AS b_price, s.price AS s_price, (b.ts < s.ts OR (b.ts = s.ts AND b.fill_id < s.fill_id)) AS long
    FROM laid b JOIN laid s ON b.account = s.account AND b.symbol = s.symbol AND b.session = s.session AND b.side = 'BUY' AND s.side = 'SELL' AND b.hi > s.hi - s.quantity AND s.hi > b.hi - b.quantity)""",
  (v.FILLS, BOOKED, "laid AS (SELECT *, sum(quantity) OVER (PARTITION BY account, symbol, session, side ORDER BY ts, fill_id ROWS UNBOUNDED PRECEDING) AS hi FROM clean)"), "entry_price exit_price points")
def fifo_round_trips(spark, d):
    return fl.fifo(_booked(spark, d))


@query("open_positions", "SELECT account, symbol, session, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END)::BIGINT AS position, count(*) AS n FROM clean GROUP BY ALL HAVING sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) <> 0", (v.FILLS, BOOKED))
def open_positions(spark, d):
    return fl.open_positions(_booked(spark, d))


RUN = "run AS (SELECT *, sum(q) OVER (PARTITION BY account, symbol, session ORDER BY ts, fill_id ROWS UNBOUNDED PRECEDING) AS pos FROM (SELECT *, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS q FROM clean))"


@query("position_zero_trades", """SELECT account, symbol, session, segment, bought AS quantity, buy_vwap, sell_vwap, (sell_vwap - buy_vwap) * bought AS points, n FROM (
  SELECT account, symbol, session, segment, sum(q) AS net, (sum(q) FILTER (q > 0))::BIGINT AS bought, sum(q * price) FILTER (q > 0) / sum(q) FILTER (q > 0) AS buy_vwap, sum(-q * price) FILTER (q < 0) / sum(-q) FILTER (q < 0) AS sell_vwap, count(*) AS n FROM (
    SELECT *, coalesce(sum(CASE WHEN pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account, symbol, session ORDER BY ts, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM run) GROUP BY ALL) WHERE net = 0""", (v.FILLS, BOOKED, RUN), "buy_vwap sell_vwap points")
def position_zero_trades(spark, d):
    return fl.position_zero(_booked(spark, d))


@query("sequence_check", "SELECT account, symbol, session, sum(q)::BIGINT AS final, count(*) FILTER (flip) AS flips FROM (SELECT *, sign(pos) * sign(lag(pos) OVER (PARTITION BY account, symbol, session ORDER BY ts, fill_id)) < 0 AS flip FROM run) GROUP BY ALL", (v.FILLS, BOOKED, RUN))
def sequence_check(spark, d):
    return fl.sequence_check(_booked(spark, d))


@query("purge_reasons", """SELECT coalesce(early, CASE WHEN abs(profit_loss - mu) > 5 * sigma AND abs(profit_loss) > 4000 THEN 'outlier' END) AS reason, count(*) AS n, sum(profit_loss) AS total FROM (
  SELECT *, avg(CASE WHEN early IS NULL THEN profit_loss END) OVER (PARTITION BY account_name) AS mu, stddev_pop(CASE WHEN early IS NULL THEN profit_loss END) OVER (PARTITION BY account_name) AS sigma FROM (
    SELECT *, CASE WHEN exit_time > TIMESTAMP '2000-01-01' + INTERVAL 5 MINUTE THEN 'future' WHEN exit_time < entry_time THEN 'negative' WHEN epoch(exit_time) - epoch(entry_time) > 86400 THEN 'too_long'
      WHEN CAST(entry_time + INTERVAL 7 HOUR AS DATE) < CAST(exit_time + INTERVAL 7 HOUR AS DATE) THEN 'crosses_close' END AS early FROM daily)) GROUP BY 1""", (v.DAILY,), "total")
def purge_reasons(spark, d):
    p = fl.purge(v.daily_trades(spark, d), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), F.col("entry_time"), F.col("exit_time"))
    return p.groupBy("reason").agg(F.count("*").alias("n"), F.sum("profit_loss").alias("total"))


@query("walk_forward", """SELECT fold, sum(n)::BIGINT AS n, sum(pnl) AS total, sum(wins) / sum(n) AS win_rate, count(*) AS days, avg(pnl) / nullif(stddev_pop(pnl), 0) * sqrt(252) AS sharpe FROM (
  SELECT fold, day, sum(pnl) AS pnl, sum(n) AS n, sum(wins) AS wins FROM part JOIN folds ON day >= test_lo AND day < test_lo + 90 JOIN (
    SELECT fold, account_name, symbol, slot FROM (SELECT *, row_number() OVER (PARTITION BY fold, symbol, slot ORDER BY round(pnl / n, 6) DESC, account_name) AS r FROM (
      SELECT fold, account_name, symbol, slot, sum(pnl) AS pnl, sum(n) AS n FROM part JOIN folds ON day >= train_lo AND day < test_lo GROUP BY ALL HAVING sum(n) >= 3)) WHERE r = 1 AND pnl > 0) USING (fold, account_name, symbol, slot)
  GROUP BY ALL) GROUP BY fold""", (v.DAILY, "part AS (SELECT account_name, symbol, slot, CAST(entry_time AS DATE) AS day, sum(profit_loss) AS pnl, count(*) AS n, count(*) FILTER (profit_loss > 0) AS wins FROM daily GROUP BY ALL)",
  "folds AS (SELECT i AS fold, lo + (i * 90)::INTEGER AS train_lo, lo + (i * 90)::INTEGER + 365 AS test_lo FROM (SELECT lo, unnest(range(0, (floor((date_diff('day', lo, hi) - 365) / 90) + 1)::BIGINT)) AS i FROM (SELECT CAST(min(entry_time) AS DATE) AS lo, CAST(max(entry_time) AS DATE) AS hi FROM daily)))"), "total win_rate sharpe")
def walk_forward(spark, d):
    return vd.walk_forward(v.daily_trades(spark, d), ["symbol", "slot"])


@query("live_validation", """SELECT *, CASE WHEN z >= -1.5 THEN 'ON_TRACK' WHEN z >= -2.5 THEN 'DRIFTING' ELSE 'CRITICAL' END AS status FROM (SELECT *, (actual - expected) / (sigma / sqrt(n_after)) AS z FROM (
  SELECT account_name, symbol, slot, avg(profit_loss) FILTER (old) AS expected, stddev_samp(profit_loss) FILTER (old) AS sigma, count(*) FILTER (old) AS n_before, avg(profit_loss) FILTER (NOT old) AS actual, count(*) FILTER (NOT old) AS n_after
  FROM (SELECT *, entry_time < TIMESTAMP '2000-01-01' AS old FROM daily) GROUP BY ALL) WHERE n_before >= 5 AND n_after >= 1 AND sigma > 0)""", (v.DAILY,), "expected sigma actual z")
def live_validation(spark, d):
    return vd.live_validation(v.daily_trades(spark, d), ["symbol", "slot"], "2000-01-01 00:00:00")


HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query("sign_flip_test", f"""SELECT any_value(seen) AS observed, avg(CASE WHEN abs(m) >= abs(seen) THEN 1.0 ELSE 0.0 END) AS p FROM (
  SELECT perm, avg(CASE WHEN {HASH.format("'42-' || perm || '-' || id")} % 2 = 0 THEN abs(value) ELSE -abs(value) END) AS m, avg(value) AS seen FROM (
    SELECT date_diff('day', DATE '2000-01-01', CAST(entry_time AS DATE)) AS id, sum(profit_loss) AS value FROM trades GROUP BY 1), range(1000) r(perm) GROUP BY 1)""", (v.TRADES,), "observed p")
def sign_flip_test(spark, d):
    days = mk.daily(v.trades(spark, d)).groupBy("date").agg(F.sum("pnl").alias("value"))
    return vd.sign_flip(days.select(F.datediff("date", F.lit("2000-01-01")).cast("long").alias("id"), "value"))


def paths_sql(sims: int = 1000, steps: int = 100, block: int = 1) -> str:
    """Bootstrapped paths of each account: mean, sigma, percentiles and chance of loss of the finals, mean worst drop."""
    w = "OVER (PARTITION BY account_name, sim ORDER BY step ROWS UNBOUNDED PRECEDING)"
    shares = ", ".join(f"quantile_cont(final, {q / 100}) AS p{q:02d}" for q in (1, 5, 10, 25, 50, 75, 90, 95, 99))
    turn = HASH.format(f"'42-' || account_name || '-' || sim || '-' || (step // {block})")
    return f"""SELECT account_name, count(*) AS sims, avg(final) AS mean, stddev_pop(final) AS sigma, {shares}, avg(CASE WHEN final < 0 THEN 1.0 ELSE 0.0 END) AS p_loss, avg(max_drop) AS mean_drop FROM (
      SELECT account_name, sim, sum(profit_loss) AS final, max(greatest(peak, 0) - equity) AS max_drop FROM (SELECT *, max(equity) {w} AS peak FROM (SELECT *, sum(profit_loss) {w} AS equity FROM (
        SELECT account_name, sim, step, ({turn} % n + step % {block}) % n AS i FROM (SELECT account_name, count(*) AS n FROM trades GROUP BY 1), range({sims}) s(sim), range({steps}) t(step))
        JOIN (SELECT account_name, profit_loss, row_number() OVER (PARTITION BY account_name ORDER BY entry_time, trade_id) - 1 AS i FROM trades) USING (account_name, i))) GROUP BY ALL) GROUP BY 1"""


@query("bootstrap_paths", paths_sql(), (v.TRADES,), "mean sigma p_loss mean_drop " + " ".join(f"p{q:02d}" for q in (1, 5, 10, 25, 50, 75, 90, 95, 99)))
def bootstrap_paths(spark, d):
    return sm.bootstrap(v.trades(spark, d))


@query("one_sample_t", "SELECT account_name, symbol, n, mean, sigma, mean / (sigma / sqrt(n)) AS t, n - 1 AS df FROM (SELECT account_name, symbol, count(*) AS n, avg(profit_loss) AS mean, stddev_samp(profit_loss) AS sigma FROM trades GROUP BY ALL) WHERE n >= 2 AND sigma > 0", (v.TRADES,), "mean sigma t")
def one_sample_t(spark, d):
    return ts.one_sample_t(v.trades(spark, d), "account_name", "symbol")


MOMENTS = "m AS (SELECT symbol, count(*) AS n, avg(profit_loss) AS mean, stddev_samp(profit_loss) AS sigma FROM trades GROUP BY 1)"


@query("welch_tests", """SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, a.mean - b.mean AS difference, (a.mean - b.mean) / sqrt(a.sigma ** 2 / a.n + b.sigma ** 2 / b.n) AS t,
  (a.sigma ** 2 / a.n + b.sigma ** 2 / b.n) ** 2 / ((a.sigma ** 2 / a.n) ** 2 / (a.n - 1) + (b.sigma ** 2 / b.n) ** 2 / (b.n - 1)) AS df,
  (a.mean - b.mean) / sqrt(((a.n - 1) * a.sigma ** 2 + (b.n - 1) * b.sigma ** 2) / (a.n + b.n - 2)) AS cohens_d FROM m a JOIN m b ON a.symbol < b.symbol WHERE a.sigma > 0 AND b.sigma > 0 AND a.n >= 2 AND b.n >= 2""", (v.TRADES, MOMENTS), "difference t df cohens_d")
def welch_tests(spark, d):
    return ts.welch(v.trades(spark, d), "symbol")


T_WITHIN = """list_sum([(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0) - (df + 1) / 2.0 * ln(1 + pow(i * abs(t) / 1000, 2) / df)) for i in range(0, 1001)])
  * abs(t) / 3000 * 2 / sqrt(df * pi())"""


@query("adjusted_p_values", f"""SELECT account_name, slot, n, t, p, least(min(p * m / k) OVER (PARTITION BY account_name ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1.0) AS q FROM (
  SELECT *, count(*) OVER (PARTITION BY account_name) AS m, row_number() OVER (PARTITION BY account_name ORDER BY p, slot) AS k FROM (SELECT *, 1 - {T_WITHIN} AS p FROM (
    SELECT account_name, slot, n, mean / (sigma / sqrt(n)) AS t, n - 1 AS df FROM (SELECT account_name, slot, count(*) AS n, avg(profit_loss) AS mean, stddev_samp(profit_loss) AS sigma FROM trades GROUP BY ALL) WHERE n >= 2 AND sigma > 0)))""", (v.TRADES,), "t p q")
def adjusted_p_values(spark, d):
    t = ts.with_p(ts.one_sample_t(v.trades(spark, d), "account_name", "slot"))
    return sr.adjusted_p(t.withColumn("id", F.col("slot")), ["account_name"]).select("account_name", "slot", "n", "t", "p", "q")


@query("snapshots", """SELECT start, start + INTERVAL 24 HOUR AS end, account_name, symbol, count(*) AS n, sum(profit_loss) AS total, count(*) FILTER (profit_loss > 0) / count(*) AS win_rate FROM (
  SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, entry_time) - k * INTERVAL 6 HOUR for k in [0, 1, 2, 3]]) AS start FROM trades) GROUP BY ALL""", (v.TRADES,), "total win_rate")
def snapshots(spark, d):
    s = mo.snapshots(v.trades(spark, d))
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("session_bursts", """SELECT min(entry_time) AS start, max(entry_time) + INTERVAL 30 MINUTE AS end, account_name, count(*) AS n, sum(profit_loss) AS total FROM (
  SELECT *, sum(f) OVER (PARTITION BY account_name ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN entry_time < lag(entry_time) OVER (PARTITION BY account_name ORDER BY entry_time, trade_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM trades)) GROUP BY account_name, s""", (v.TRADES,), "total")
def session_bursts(spark, d):
    s = mo.sessions(v.trades(spark, d))
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("top_trades", "SELECT trade_id, account_name, symbol, profit_loss FROM trades ORDER BY abs(profit_loss) DESC, trade_id LIMIT 20", (v.TRADES,), "profit_loss")
def top_trades(spark, d):
    return v.trades(spark, d).orderBy(F.desc(F.abs("profit_loss")), "trade_id").limit(20).select("trade_id", "account_name", "symbol", "profit_loss")


@query("large_trades_flagged", f"""SELECT t.trade_id, t.profit_loss, m.account_name AS recommended, t.account_name IS NOT DISTINCT FROM m.account_name AS follows FROM (SELECT * FROM trades WHERE abs(profit_loss) > 50) t LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, slot, dow ORDER BY mean DESC, win_rate DESC, account_name) AS r FROM ({STATS.format(t="fresh", k=3)})) WHERE r = 1 AND mean > 0) m USING (symbol, slot, dow)""", (v.TRADES, FRESH), "profit_loss")
def large_trades_flagged(spark, d):
    t = v.trades(spark, d)
    best = sl.slot_matrix(t).select("symbol", "slot", "dow", F.col("account_name").alias("recommended"))
    return t.filter(F.abs("profit_loss") > 50).join(best, sl.CELL, "left").select("trade_id", "profit_loss", "recommended", F.col("account_name").eqNullSafe(F.col("recommended")).alias("follows"))


@query("regime_performance", """SELECT account_name, regime, count(*) AS n, sum(profit_loss) AS total, count(*) FILTER (profit_loss > 0) / count(*) AS win_rate, avg(profit_loss) / nullif(stddev_samp(profit_loss), 0) * sqrt(252) AS sharpe FROM (
  SELECT t.*, CASE WHEN close < 15 THEN 'Low' WHEN close <= 25 THEN 'Medium' ELSE 'High' END AS regime FROM trades t JOIN (
    SELECT d.day, max_by(close, date) AS close FROM (SELECT DISTINCT CAST(entry_time AS DATE) AS day FROM trades) d JOIN market ON date <= d.day AND date >= d.day - 3 GROUP BY 1) m ON m.day = CAST(t.entry_time AS DATE)) GROUP BY ALL""", (v.TRADES, v.MARKET), "total win_rate sharpe")
def regime_performance(spark, d):
    return mk.regime_performance(v.trades(spark, d), v.market(spark, d))


@query("rolling_correlation", """SELECT account_name, date, CASE WHEN count(*) OVER w >= 5 THEN corr(x, y) OVER w END AS correlation, CASE WHEN count(*) OVER w >= 5 THEN covar_pop(x, y) OVER w / nullif(var_pop(x) OVER w, 0) END AS slope
  FROM (SELECT account_name, date, close AS x, pnl AS y FROM days JOIN market USING (date)) WINDOW w AS (PARTITION BY account_name ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""", (v.TRADES, v.MARKET, DAYS), "correlation slope")
def rolling_correlation(spark, d):
    pairs = mk.daily(v.trades(spark, d)).join(v.market(spark, d), "date").select("account_name", "date", F.col("close").alias("x"), F.col("pnl").alias("y"))
    return sr.rolling_correlation(pairs, 5, "account_name").select("account_name", "date", "correlation", "slope")
