"""Further queries of the catalogue, and their SQL: one-to-one audits, sticky walk-forward, scenarios, resampling, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import timeplane as tp
from ledgerloom.functions.gammas import normal_quantile_sql
from ledgerloom.operators import audit as au
from ledgerloom.operators import ensemble as en
from ledgerloom.operators import fills as fl
from ledgerloom.operators import fits as ft
from ledgerloom.operators import learn as ln
from ledgerloom.operators import market as mk
from ledgerloom.operators import matching as mc
from ledgerloom.operators import metrics as mt
from ledgerloom.operators import optimize as op
from ledgerloom.operators import recommend as rc
from ledgerloom.operators import resample as rs
from ledgerloom.operators import scenarios as sc
from ledgerloom.operators import series as sr
from ledgerloom.operators import slots as sl
from ledgerloom.operators import stacking as sk

from . import views as v
from .catalog import DATED, HASH, PHI, booked_sql, query

_SIDES = """l AS (SELECT fill_id AS id, account, side, ts, price FROM fills WHERE fill_id % 2 = 0), r AS (SELECT fill_id AS id, account, side, ts, price FROM fills WHERE fill_id % 2 = 1)"""
_PAIRS = """pairs AS (SELECT l.account, l.id AS l_id, r.id AS r_id, abs(epoch(l.ts) - epoch(r.ts)) AS gap, abs(l.price - r.price) AS apart,
  row_number() OVER (PARTITION BY l.account ORDER BY abs(epoch(l.ts) - epoch(r.ts)), abs(l.price - r.price), l.id, r.id) AS k
  FROM l JOIN r ON l.account = r.account AND l.side = r.side AND abs(epoch(l.ts) - epoch(r.ts)) <= 7200 AND abs(l.price - r.price) <= 60)"""


def _sides(spark, d):
    f = v.fills(spark, d).withColumn("id", F.col("fill_id"))
    return f.filter("fill_id % 2 = 0"), f.filter("fill_id % 2 = 1")


# Two logs of one day: fills of even and of odd ids. The SQL walks the pairs of an account from the nearest on.
@query("audit_matches", """WITH RECURSIVE walk AS (
    SELECT account, 0::BIGINT AS k, []::BIGINT[] AS ls, []::BIGINT[] AS rs, NULL::BIGINT AS l_id, NULL::BIGINT AS r_id, NULL::DOUBLE AS gap, NULL::DOUBLE AS apart FROM (SELECT DISTINCT account FROM pairs)
    UNION ALL
    SELECT w.account, p.k, CASE WHEN free THEN list_append(w.ls, p.l_id) ELSE w.ls END, CASE WHEN free THEN list_append(w.rs, p.r_id) ELSE w.rs END,
      CASE WHEN free THEN p.l_id END, CASE WHEN free THEN p.r_id END, p.gap, p.apart
    FROM (SELECT w.*, p.k AS pk, NOT list_contains(w.ls, p.l_id) AND NOT list_contains(w.rs, p.r_id) AS free FROM walk w JOIN pairs p ON p.account = w.account AND p.k = w.k + 1) w JOIN pairs p ON p.account = w.account AND p.k = w.pk)
  SELECT l_id, r_id, gap, apart FROM walk WHERE l_id IS NOT NULL""", (v.FILLS, _SIDES, _PAIRS), "gap apart")
def audit_matches(spark, d):
    left, right = _sides(spark, d)
    return au.matched(left, right, ["account", "side"], seconds=7200, price=60.0).select("l_id", "r_id", "gap", "apart")


@query("audit_summary", """SELECT account, side, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM pairs p WHERE p.l_id = l.id)) AS matchable FROM l GROUP BY ALL""", (v.FILLS, _SIDES, _PAIRS))
def audit_summary(spark, d):
    left, right = _sides(spark, d)
    can = au.candidates(left, right, ["account", "side"], seconds=7200, price=60.0).select(F.col("l_id").alias("id")).distinct().withColumn("can", F.lit(True))
    return left.join(can, "id", "left").groupBy("account", "side").agg(F.count("*").alias("n"), F.count_if(F.col("can")).alias("matchable"))


ORDER_INDEX = "order_index AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 7000 AS close FROM orders GROUP BY 1)"


def order_index(spark, d):
    """A daily index over the years of the daily trades: the mean order, scaled into the range of a volatility index."""
    return v.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 7000).alias("close"))


_STICKY = """WITH RECURSIVE
  span AS (SELECT min(CAST(entry_time AS DATE)) AS lo, max(CAST(entry_time AS DATE)) AS hi FROM daily),
  f AS (SELECT fold, lo + fold::INTEGER * 90 AS train_lo, lo + fold::INTEGER * 90 + 364 AS train_hi FROM (SELECT lo, unnest(range(0, (hi - lo - 364) // 90 + 1)) AS fold FROM span)),
  s AS (SELECT fold, train_hi, part, 364 // (part + 1) AS days FROM f, (SELECT unnest([0, 1, 2]) AS part)),
  c AS (SELECT fold, part, days, account_name, symbol, slot, count(*) AS n, avg(profit_loss) AS mean, 100.0 * count(*) FILTER (profit_loss > 0) / count(*) AS rate, avg(profit_loss * profit_loss) - avg(profit_loss) * avg(profit_loss) AS variance
    FROM daily JOIN s ON CAST(entry_time AS DATE) >= train_hi - days AND CAST(entry_time AS DATE) < train_hi GROUP BY ALL HAVING count(*) >= greatest(3, 3 * days // 364)),
  g AS (SELECT *, round((0.6 * least(2, mean / 25) + 0.4 * least(2, 10 * mean / sqrt(greatest(1, variance)) / 4)) * CASE WHEN mean < 0 OR rate < 40 THEN 0.1 ELSE 1 END, 9) AS score FROM c),
  b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY fold, part, symbol, slot ORDER BY score DESC, account_name) = 1),
  m AS (SELECT fold, arg_max(close, date) AS close FROM f JOIN order_index ON date >= train_hi - 30 AND date < train_hi GROUP BY 1),
  t AS (SELECT b.fold, symbol, slot, account_name, round(sum(score * CASE WHEN part = 0 THEN 1 ELSE 0.7 END + CASE WHEN (close > 25 AND mean > 30) OR (close < 15 AND rate > 70) THEN 0.1 ELSE 0 END), 8) AS votes FROM b LEFT JOIN m USING (fold) GROUP BY ALL),
  top AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY fold, symbol, slot ORDER BY votes DESC, account_name) = 1),
  state AS (
    SELECT 0::BIGINT AS fold, symbol, slot, account_name, votes, votes > 0.8 AS picked FROM top WHERE fold = 0
    UNION ALL
    SELECT n.fold, n.symbol, n.slot, n.account_name, n.votes, n.votes + CASE WHEN o.picked AND o.account_name = n.account_name THEN 0.3 ELSE 0 END > 0.8
    FROM (SELECT DISTINCT fold FROM state) x JOIN top n ON n.fold = x.fold + 1 LEFT JOIN state o ON o.fold = x.fold AND o.symbol = n.symbol AND o.slot = n.slot),
  picks AS (SELECT fold, symbol, slot, account_name, votes FROM state WHERE picked)"""


@query("sticky_picks", _STICKY + " SELECT fold, symbol, slot, account_name, votes FROM picks", (v.DAILY, ORDER_INDEX), "votes")
def sticky_picks(spark, d):
    from ledgerloom.operators.validation import folds

    trades, keys = v.daily_trades(spark, d), ["symbol", "slot"]
    p = F.col("profit_loss")
    partial = trades.groupBy("account_name", *keys, F.to_date("entry_time").alias("day")).agg(F.sum(p).alias("pnl"), F.sum(p * p).alias("square"), F.count("*").alias("n"), F.count_if(p > 0).alias("wins"))
    f = folds(trades, 364, 90)
    votes = en.window_votes(partial, f, keys, en.fold_regimes(f, order_index(spark, d)), min_trades=3, min_mean=0.0, min_win_rate=40.0)
    return en.sticky_picks(votes, keys)


@query("sticky_walk_forward", _STICKY + """ SELECT fold, cells, n, total, win_rate, sharpe FROM (SELECT fold, count(*) AS cells FROM picks GROUP BY 1) LEFT JOIN (
    SELECT p.fold, count(*) AS n, sum(profit_loss) AS total, count(*) FILTER (profit_loss > 0) / count(*) AS win_rate, avg(profit_loss) / nullif(stddev_samp(profit_loss), 0) * sqrt(count(*) / 90 * 252) AS sharpe
    FROM daily d JOIN f ON CAST(entry_time AS DATE) >= train_hi AND CAST(entry_time AS DATE) < train_hi + 90 JOIN picks p ON p.fold = f.fold AND p.symbol = d.symbol AND p.slot = d.slot AND p.account_name = d.account_name GROUP BY 1) USING (fold)""",
  (v.DAILY, ORDER_INDEX), "total win_rate sharpe")
def sticky_walk_forward(spark, d):
    return en.sticky_walk_forward(v.daily_trades(spark, d), ["symbol", "slot"], order_index(spark, d), min_win_rate=40.0)


VALS = "vals AS (SELECT account_name AS key, profit_loss AS x, count(*) AS c FROM trades GROUP BY ALL), mo AS (SELECT key, n, mean, sum(c * pow(x - mean, 2)) / n AS variance FROM (SELECT *, sum(c) OVER (PARTITION BY key) AS n, sum(c * x) OVER (PARTITION BY key) / sum(c) OVER (PARTITION BY key) AS mean FROM vals) GROUP BY key, n, mean)"
_HALF = "(0.5 * ln(2 * pi()))"
_EM = """em AS (
    SELECT 0 AS it, key, n, variance, 0.5::DOUBLE AS w, mean - sqrt(variance) AS m1, variance AS v1, mean + sqrt(variance) AS m2, variance AS v2 FROM mo
    UNION ALL
    SELECT it + 1, key, n, variance, least(greatest(r0 / n, 1e-9), 1 - 1e-9), r1 / r0, greatest(r2 / r0 - pow(r1 / r0, 2), variance * 1e-6), q1 / q0, greatest(q2 / q0 - pow(q1 / q0, 2), variance * 1e-6) FROM (
      SELECT it, key, n, variance, sum(c * r) AS r0, sum(c * r * x) AS r1, sum(c * r * x * x) AS r2, sum(c * (1 - r)) AS q0, sum(c * (1 - r) * x) AS q1, sum(c * (1 - r) * x * x) AS q2 FROM (
        SELECT em.*, x, c, 1 / (1 + exp(least(greatest(ln(1 - w) - 0.5 * ln(v2) - pow(x - m2, 2) / (2 * v2) - ln(w) + 0.5 * ln(v1) + pow(x - m1, 2) / (2 * v1), -700), 700))) AS r FROM em JOIN vals USING (key) WHERE it < 10) GROUP BY ALL))"""


# Ten steps of expectation-maximisation; the SQL takes them one after another by recursion.
@query("mixture_fits", f"""WITH RECURSIVE {_EM} SELECT key, n, w, m1, v1, m2, v2, sum(c * (greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))))) AS log_likelihood FROM (
  SELECT em.*, c, ln(w) - {_HALF} - 0.5 * ln(v1) - pow(x - m1, 2) / (2 * v1) AS a, ln(1 - w) - {_HALF} - 0.5 * ln(v2) - pow(x - m2, 2) / (2 * v2) AS b FROM em JOIN vals USING (key) WHERE it = 10) GROUP BY ALL""",
  (v.TRADES, VALS), "w m1 v1 m2 v2 log_likelihood")
def mixture_fits(spark, d):
    return ft.mixtures(ft.valued(v.trades(spark, d), "account_name", "profit_loss"), 10).withColumn("n", F.col("n").cast("long"))


_SUMMARY = "SELECT key, count(*) AS sims, avg(final) AS mean, stddev_samp(final) AS sigma, quantile_cont(final, 0.05) AS p05, quantile_cont(final, 0.5) AS p50, quantile_cont(final, 0.95) AS p95, avg(CASE WHEN final < 0 THEN 1.0 ELSE 0.0 END) AS p_loss"


def _u(text: str) -> str:
    """A uniform draw, as :func:`ledgerloom.operators.scenarios.uniform` makes it."""
    return f"(({HASH.format(text)} + 0.5) / 4294967296.0)"


@query("mixture_scenarios", f"""WITH RECURSIVE {_EM} {_SUMMARY} FROM (SELECT key, sim, sum(CASE WHEN part < w THEN m1 + sqrt(v1) * z ELSE m2 + sqrt(v2) * z END) AS final FROM (
  SELECT *, {normal_quantile_sql('u')} AS z FROM (SELECT em.*, sim, step, {_u("'42-' || key || '-' || sim || '-' || step || '-z'")} AS u, {_u("'42-' || key || '-' || sim || '-' || step || '-part'")} AS part FROM em, range(200) a(sim), range(50) b(step) WHERE it = 10)) GROUP BY ALL) GROUP BY key""",
  (v.TRADES, VALS), "mean sigma p05 p50 p95 p_loss")
def mixture_scenarios(spark, d):
    return sc.finals_summary(sc.mixture_paths(ft.mixtures(ft.valued(v.trades(spark, d), "account_name", "profit_loss"), 10), 200, 50))


_CHOLESKY = """days AS (SELECT CAST(entry_time AS DATE) AS date, """ + ", ".join(f"coalesce(sum(profit_loss) FILTER (account_name = 'ACC_{i}'), 0) AS p{i}" for i in range(4)) + """ FROM trades GROUP BY 1),
  r AS (SELECT """ + ", ".join(f"corr(p{i}, p{j}) AS r{i}{j}" for i in range(4) for j in range(i)) + ", " + ", ".join(f"avg(p{i}) AS m{i}, stddev_samp(p{i}) AS s{i}" for i in range(4)) + """ FROM days),
  l1 AS (SELECT *, sqrt(1 - r10 * r10) AS l11 FROM r), l2 AS (SELECT *, (r21 - r20 * r10) / l11 AS l21, (r31 - r30 * r10) / l11 AS l31 FROM l1),
  l3 AS (SELECT *, sqrt(1 - r20 * r20 - l21 * l21) AS l22 FROM l2), l4 AS (SELECT *, (r32 - r30 * r20 - l31 * l21) / l22 AS l32 FROM l3), l5 AS (SELECT *, sqrt(1 - r30 * r30 - l31 * l31 - l32 * l32) AS l33 FROM l4),
  z AS (SELECT sim, day, """ + ", ".join(f"max(z) FILTER (a = {i}) AS z{i}" for i in range(4)) + f""" FROM (SELECT *, {normal_quantile_sql('u')} AS z FROM (SELECT sim, day, a, {_u("'42-ACC_' || a || '-' || sim || '-' || day")} AS u FROM range(100) x(sim), range(20) y(day), range(4) t(a))) GROUP BY ALL)"""


@query("correlated_scenarios", """SELECT sim, day, 'ACC_' || a AS account_name, CASE a WHEN 0 THEN m0 + s0 * z0 WHEN 1 THEN m1 + s1 * (r10 * z0 + l11 * z1) WHEN 2 THEN m2 + s2 * (r20 * z0 + l21 * z1 + l22 * z2) ELSE m3 + s3 * (r30 * z0 + l31 * z1 + l32 * z2 + l33 * z3) END AS pnl
  FROM z, l5, range(4) t(a)""", (v.TRADES, _CHOLESKY), "pnl")
def correlated_scenarios(spark, d):
    return sc.correlated(v.trades(spark, d), 100, 20)


_DAYS = "rg AS (SELECT date, CASE WHEN close < 15 THEN 'Low' WHEN close <= 25 THEN 'Medium' ELSE 'High' END AS regime FROM market), br AS (SELECT account_name AS key, regime, avg(profit_loss) AS mean, stddev_samp(profit_loss) AS sigma FROM trades JOIN rg ON CAST(entry_time AS DATE) = date GROUP BY ALL)"
_MOVES = "mv AS (SELECT regime, list({'to_regime': to_regime, 'cum': cum} ORDER BY to_regime) AS moves FROM (SELECT regime, to_regime, sum(share) OVER (PARTITION BY regime ORDER BY to_regime) AS cum FROM (SELECT regime, to_regime, n / sum(n) OVER (PARTITION BY regime) AS share FROM (SELECT regime, to_regime, count(*) AS n FROM (SELECT regime, lead(regime) OVER (ORDER BY date) AS to_regime FROM rg) WHERE to_regime IS NOT NULL GROUP BY ALL))) GROUP BY 1)"


@query("regime_scenarios", f"""WITH RECURSIVE st AS (
    SELECT sim, -1::BIGINT AS step, 'Medium' AS regime FROM range(100) t(sim)
    UNION ALL
    SELECT sim, step + 1, coalesce(list_filter(moves, lambda x: u < x.cum)[1].to_regime, moves[-1].to_regime, regime) FROM (SELECT st.*, moves, {_u("'42-regime-' || sim || '-' || (step + 1)")} AS u FROM st LEFT JOIN mv USING (regime) WHERE step < 29))
  {_SUMMARY} FROM (SELECT key, sim, sum(mean + coalesce(sigma, 0) * z) AS final FROM (SELECT *, {normal_quantile_sql('u')} AS z FROM (SELECT br.*, sim, step, {_u("'42-' || key || '-' || sim || '-' || step")} AS u FROM st JOIN br USING (regime) WHERE step >= 0)) GROUP BY ALL) GROUP BY key""",
  (v.TRADES, v.MARKET, _DAYS, _MOVES), "mean sigma p05 p50 p95 p_loss")
def regime_scenarios(spark, d):
    market = sr.regimes(v.market(spark, d)).select("date", "regime")
    by = v.trades(spark, d).withColumn("date", F.to_date("entry_time")).join(market, "date").groupBy(F.col("account_name").alias("key"), "regime").agg(F.avg("profit_loss").alias("mean"), F.stddev_samp("profit_loss").alias("sigma"))
    pairs = sr.regime_transitions(v.market(spark, d))
    shares = pairs.join(pairs.groupBy("regime").agg(F.sum("n").alias("all")), "regime").select("regime", "to_regime", (F.col("n") / F.col("all")).alias("share"))
    return sc.finals_summary(sc.regime_paths(by, shares, 100, 30, "Medium"))


_VS = ", ".join(str(x) for x in ft.FREEDOMS)
_STUDENT = f"""st AS (
    SELECT 0 AS it, key, n, unnest([{_VS}])::DOUBLE AS v, mean AS m, variance AS s2 FROM mo
    UNION ALL
    SELECT it + 1, key, n, v, w1 / w0, (w2 - w1 / w0 * w1) / n FROM (SELECT it, key, n, v, sum(c * w) AS w0, sum(c * w * x) AS w1, sum(c * w * x * x) AS w2 FROM (
      SELECT st.*, x, c, (v + 1) / (v + pow(x - m, 2) / s2) AS w FROM st JOIN vals USING (key) WHERE it < 30) GROUP BY ALL))"""
_LOGCDF = "CASE WHEN z < -5 THEN -z * z / 2 - " + _HALF + " - ln(greatest(-z, 1.0)) + ln(1 - 1 / (z * z) + 3 / pow(z, 4)) ELSE ln(greatest(" + PHI.replace("{z}", "z") + ", 1e-300)) END"
_SKEWED = f"""s0 AS (SELECT key, n, mean, variance, least(greatest(sum(c * pow((x - mean) / sqrt(variance), 3)) / n, -0.9), 0.9) AS lean FROM mo JOIN vals USING (key) GROUP BY key, n, mean, variance),
  s1 AS (SELECT *, pow(2 * abs(lean) / (4 - pi()), 2 / 3::DOUBLE) AS third FROM s0), s2 AS (SELECT *, sign(lean) * sqrt(pi() / 2 * third / (1 + third)) AS delta FROM s1), s3 AS (SELECT *, sqrt(variance / (1 - 2 * delta * delta / pi())) AS scale, CASE WHEN abs(delta) < 0.05 THEN 0.05 ELSE delta END AS dl FROM s2),
  sk AS (
    SELECT 0 AS it, key, n, mean - scale * delta * sqrt(2 / pi()) AS loc, scale * dl AS d, scale * scale * (1 - dl * dl) AS t FROM s3
    UNION ALL
    SELECT it + 1, key, n, na, nd, greatest((sxx - 2 * na * sx + n * na * na - 2 * nd * (sx1 - na * s1) + nd * nd * s2) / n, 1e-12) FROM (SELECT *, (sx1 - na * s1) / s2 AS nd FROM (SELECT *, (sx - d * s1) / n AS na FROM (
      SELECT it, key, n, loc, d, sum(c * x) AS sx, sum(c * x * x) AS sxx, sum(c * e1) AS s1, sum(c * e2) AS s2, sum(c * x * e1) AS sx1 FROM (SELECT *, mu + s * h AS e1, mu * mu + s * s + mu * s * h AS e2 FROM (SELECT *, exp(-z * z / 2 - {_HALF} - lc) AS h FROM (SELECT *, {_LOGCDF} AS lc FROM (
        SELECT *, mu / s AS z FROM (SELECT sk.*, x, c, d * (x - loc) / (d * d + t) AS mu, sqrt(t / (d * d + t)) AS s FROM sk JOIN vals USING (key) WHERE it < 60))))) GROUP BY ALL))))"""


@query("distribution_fits", f"""WITH RECURSIVE {_STUDENT}, {_SKEWED},
  tf AS (SELECT key, n, v, m, s2, sum(c * (lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * ln(v * pi()) - 0.5 * ln(s2) - (v + 1) / 2 * ln(1 + pow(x - m, 2) / (s2 * v)))) AS ll FROM st JOIN vals USING (key) WHERE it = 30 GROUP BY ALL),
  kf AS (SELECT key, n, loc, d, t, sum(c * (ln(2) - {_HALF} - 0.5 * ln(d * d + t) - pow(x - loc, 2) / (2 * (d * d + t)) + {_LOGCDF})) AS ll FROM (SELECT *, d / sqrt(t) * (x - loc) / sqrt(d * d + t) AS z FROM sk JOIN vals USING (key) WHERE it = 60) GROUP BY ALL),
  f AS (
    SELECT key, n, 'normal' AS model, 2 AS k, mean AS location, sqrt(variance) AS scale, NULL::DOUBLE AS shape, -n * ({_HALF} + 0.5 * ln(variance) + 0.5) AS log_likelihood FROM mo
    UNION ALL SELECT key, n, 'student', 3, m, sqrt(s2), v, ll FROM tf QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(ll, 6) DESC, v DESC) = 1
    UNION ALL SELECT key, n, 'skewed', 3, loc, sqrt(d * d + t), d / sqrt(t), ll FROM kf)
  SELECT key, n::BIGINT AS n, model, k, location, scale, shape, log_likelihood, 2 * k - 2 * log_likelihood AS aic, row_number() OVER (PARTITION BY key ORDER BY round(2 * k - 2 * log_likelihood, 6), k, model) = 1 AS best FROM f""",
  (v.TRADES, VALS), "location scale shape log_likelihood aic")
def distribution_fits(spark, d):
    return ft.best_fits(ft.valued(v.trades(spark, d), "account_name", "profit_loss")).withColumn("n", F.col("n").cast("long"))


@query("block_maxima", """SELECT account_name, n::BIGINT AS blocks, location, scale, k AS shape, worst, location + scale / k * (1 - pow(-ln(0.999), k)) AS level_999, location + scale / k * (1 - pow(-ln(0.9995), k)) AS level_9995, location + scale / k * (1 - pow(-ln(0.9999), k)) AS level_9999 FROM (
  SELECT *, b0 - scale * (1 - gamma(1 + k)) / k AS location FROM (SELECT *, l2 * k / ((1 - pow(2, -k)) * gamma(1 + k)) AS scale FROM (SELECT *, 7.8590 * c + 2.9554 * c * c AS k FROM (SELECT *, 2 / (3 + (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0)) - ln(2) / ln(3) AS c, 2 * b1 - b0 AS l2 FROM (
    SELECT account_name, n, avg(loss) AS b0, sum(loss * j) / (n * (n - 1)) AS b1, sum(loss * j * (j - 1)) / (n * (n - 1) * (n - 2)) AS b2, max(loss) AS worst FROM (
      SELECT *, count(*) OVER (PARTITION BY account_name)::DOUBLE AS n, (row_number() OVER (PARTITION BY account_name ORDER BY loss, block) - 1)::DOUBLE AS j FROM (
        SELECT account_name, (nth - 1) // 21 AS block, max(-profit_loss) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY entry_time, trade_id) AS nth FROM trades) GROUP BY ALL HAVING count(*) = 21)) WHERE n >= 10 GROUP BY account_name, n)))))""",
  (v.TRADES,), "location scale shape worst level_999 level_9995 level_9999")
def block_maxima(spark, d):
    return ft.block_maxima(v.trades(spark, d), "account_name", 21)


_CUTS = ", ".join(f"{p!r}" for p in rs.POISSON)


# Intervals of the mean, the win rate and the profit factor of every account's symbol, of 100 resamples.
@query("bootstrap_intervals", f"""SELECT account_name, symbol, statistic, value, low, high, error FROM (
  SELECT account_name, symbol, statistic, value FROM (SELECT account_name, symbol, avg(profit_loss) AS mean, avg(CASE WHEN profit_loss > 0 THEN 1.0 ELSE 0 END) AS win_rate, sum(profit_loss) FILTER (profit_loss > 0) / -(sum(profit_loss) FILTER (profit_loss <= 0)) AS profit_factor FROM trades GROUP BY ALL)
    UNPIVOT INCLUDE NULLS (value FOR statistic IN (mean, win_rate, profit_factor))) JOIN (
  SELECT account_name, symbol, statistic, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high, stddev_samp(value) AS error FROM (
    SELECT account_name, symbol, sim, sum(w * profit_loss) / sum(w) AS mean, sum(w * (profit_loss > 0)::INT) / sum(w) AS win_rate, sum(w * greatest(profit_loss, 0)) / nullif(-sum(w * least(profit_loss, 0)), 0) AS profit_factor FROM (
      SELECT *, len(list_filter([{_CUTS}], lambda c: c <= u))::DOUBLE AS w FROM (SELECT *, {_u("'42-' || trade_id || '-' || sim")} AS u FROM trades, range(100) t(sim))) GROUP BY ALL)
    UNPIVOT INCLUDE NULLS (value FOR statistic IN (mean, win_rate, profit_factor)) GROUP BY ALL) USING (account_name, symbol, statistic)""", (v.TRADES,), "value low high error")
def bootstrap_intervals(spark, d):
    p = F.col("profit_loss")
    statistics = {
        "mean": lambda w: F.sum(w * p) / F.nullif(F.sum(w), F.lit(0.0)),
        "win_rate": lambda w: F.sum(w * (p > 0).cast("double")) / F.nullif(F.sum(w), F.lit(0.0)),
        "profit_factor": lambda w: F.sum(w * F.greatest(p, F.lit(0.0))) / F.nullif(-F.sum(w * F.least(p, F.lit(0.0))), F.lit(0.0)),
    }
    return rs.intervals(v.trades(spark, d), ["account_name", "symbol"], "trade_id", statistics, sims=100)


_PRIMES = f"[{', '.join(map(str, rs.large_primes()))}]"
_PICK = "{primes}[1 + {h} % 64]"
_P1, _P2 = (_PICK.replace("{primes}", _PRIMES).replace("{h}", HASH.format(f"'42-' || account_name || '-' || perm || '-{x}'")) for x in "pq")
_LUCK = f"""place AS (SELECT account_name, profit_loss, row_number() OVER (PARTITION BY account_name ORDER BY {HASH.format("'42-' || trade_id")}, trade_id) - 1 AS place, count(*) OVER (PARTITION BY account_name) AS size FROM trades),
  cells AS (SELECT account_name, hour, n, pnl, wins, sum(n) OVER (PARTITION BY account_name ORDER BY hour) - n AS lo, sum(n) OVER (PARTITION BY account_name ORDER BY hour) AS hi FROM (SELECT account_name, hour, count(*) AS n, sum(profit_loss) AS pnl, count(*) FILTER (profit_loss > 0) AS wins FROM trades GROUP BY ALL)),
  keyed AS (SELECT account_name, perm, (({_P1} % size) * ({_P2} % size)) % size AS a, {HASH.format("'42-' || account_name || '-' || perm || '-b'")} % size AS b FROM (SELECT DISTINCT account_name, size FROM place), range(100) t(perm)),
  dealt AS (SELECT perm, account_name, hour, count(*) AS n, sum(profit_loss) AS pnl, count(*) FILTER (profit_loss > 0) AS wins FROM (SELECT perm, account_name, profit_loss, (a * place + b) % size AS spot FROM place JOIN keyed USING (account_name)) JOIN cells c USING (account_name) WHERE spot >= lo AND spot < hi GROUP BY ALL),
  twice AS (SELECT perm, account_name, hour, n, pnl, wins FROM dealt UNION ALL SELECT -1, account_name, hour, n, pnl, wins FROM cells),
  tested AS (SELECT *, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) for i in range(wins, n + 1)]) AS p FROM twice WHERE n >= 30),
  q AS (SELECT *, min(p * m / k) OVER (PARTITION BY account_name, perm ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS q FROM (SELECT *, count(*) OVER (PARTITION BY account_name, perm) AS m, row_number() OVER (PARTITION BY account_name, perm ORDER BY p, hour) AS k FROM tested)),
  found AS (SELECT perm, count(*) AS cells, sum(n) AS n, sum(pnl) AS total FROM q WHERE q <= 0.5 AND 2 * wins >= n AND pnl > 0 GROUP BY 1),
  luck AS (SELECT perm, coalesce(cells, 0)::BIGINT AS cells, coalesce(n, 0)::BIGINT AS n, coalesce(total, 0.0)::DOUBLE AS total FROM (SELECT unnest(range(-1, 100)) AS perm) LEFT JOIN found USING (perm))"""


# Hours selected at a rate of 0.5 (the tables hold no strong hour), and 100 permutations within accounts.
@query("label_permutations", "SELECT perm::INTEGER AS perm, cells, n, total FROM luck", (v.TRADES, _LUCK), "total")
def label_permutations(spark, d):
    return rs.selected_by_luck(v.trades(spark, d), "account_name", ["hour"], perms=100, rate=0.5)


@query("luck_test", "SELECT cells, total, count(*) AS perms, avg(c) AS mean_cells, avg(t) AS mean_total, avg((c >= cells)::INT) AS p_cells, avg((t >= total)::INT) AS p_total FROM (SELECT cells, total FROM luck WHERE perm = -1), (SELECT cells AS c, total AS t FROM luck WHERE perm >= 0) GROUP BY ALL", (v.TRADES, _LUCK), "total mean_cells mean_total p_cells p_total")
def luck_test(spark, d):
    return rs.luck_test(rs.selected_by_luck(v.trades(spark, d), "account_name", ["hour"], perms=100, rate=0.5))


@query("stacking_test")
def stacking_test(spark, d):
    return sk.stacking_test(ln.table(v.trades(spark, d), "account_name"))


@query("permutation_importance")
def permutation_importance(spark, d):
    rows = sk.in_blocks(ln.table(v.trades(spark, d), "account_name"), 2)
    model = sk.pipeline("forest", ln.INPUTS, "profit_loss").fit(rows.filter("block = 0"))
    return sk.permutation_importance(model, rows.filter("block = 1"), ln.INPUTS, "trade_id")


DATED |= dict.fromkeys(["engine_fills", "engine_trips", "orphaned_closes", "parent_fallback_trips"], "session")
_TAGGED = "tagged AS (SELECT *, 'log' || (fill_id % 3) AS file, fill_id // 2 AS order_id, CASE WHEN fill_id % 11 = 0 THEN 'Text: AutoTrader_9' WHEN fill_id % 4 = 0 THEN 'Trade simulation fill' END AS message FROM fills)"
_ENGINE = booked_sql("tagged", "account, symbol, file", ", order_id", "AND NOT coalesce(regexp_matches(lower(message), 'autotrader_|at_|text: tag:'), false)")
_TRIPS = """SELECT account, symbol, session, CASE WHEN long THEN 'LONG' ELSE 'SHORT' END AS direction, (hi - lo)::BIGINT AS quantity, CASE WHEN long THEN b_ts ELSE s_ts END AS entry_time, CASE WHEN long THEN s_ts ELSE b_ts END AS exit_time,
  CASE WHEN long THEN b_price ELSE s_price END AS entry_price, CASE WHEN long THEN s_price ELSE b_price END AS exit_price, (s_price - b_price) * (hi - lo) AS points
  FROM (SELECT b.account, b.symbol, b.session, greatest(b.hi - b.quantity, s.hi - s.quantity) AS lo, least(b.hi, s.hi) AS hi, b.ts AS b_ts, s.ts AS s_ts, b.price AS b_price, s.price AS s_price, (b.ts < s.ts OR (b.ts = s.ts AND b.fill_id < s.fill_id)) AS long
    FROM laid b JOIN laid s ON b.account = s.account AND b.symbol = s.symbol AND b.session = s.session AND b.side = 'BUY' AND s.side = 'SELL' AND b.hi > s.hi - s.quantity AND s.hi > b.hi - b.quantity)"""
_LAID = "laid AS (SELECT *, sum(quantity) OVER (PARTITION BY account, symbol, session, side ORDER BY ts, fill_id ROWS UNBOUNDED PRECEDING) AS hi FROM {})"


def _engine(spark, d):
    f = v.fills(spark, d)
    message = F.when(F.col("fill_id") % 11 == 0, "Text: AutoTrader_9").when(F.col("fill_id") % 4 == 0, "Trade simulation fill")
    f = f.withColumns({"file": F.concat(F.lit("log"), (F.col("fill_id") % 3).cast("string")), "order_id": F.floor(F.col("fill_id") / 2).cast("long"), "message": message})
    local = tp.new_york(F.col("ts"))
    return fl.engine(f, local, tp.session_date(local), by=("account", "symbol", "file"), extra=("order_id",), message="message")


# Fills with files, orders and messages through the whole chain, row by row.
@query("engine_fills", "SELECT fill_id, account, symbol, session, side, quantity, price, open_close FROM clean", (v.FILLS, _TAGGED, _ENGINE), "price")
def engine_fills(spark, d):
    return _engine(spark, d).select("fill_id", "account", "symbol", "session", "side", "quantity", "price", "open_close")


@query("engine_trips", _TRIPS, (v.FILLS, _TAGGED, _ENGINE, _LAID.format("clean")), "entry_price exit_price points")
def engine_trips(spark, d):
    return fl.fifo(_engine(spark, d))


@query("orphaned_closes", "SELECT fill_id, account, symbol, session FROM kept WHERE fill_id NOT IN (SELECT fill_id FROM clean)", (v.FILLS, booked_sql()))
def orphaned_closes(spark, d):
    f, local = v.fills(spark, d), tp.new_york(F.col("ts"))
    marked = fl.classified(fl.plausible(f), F.hour(local) * 60 + F.minute(local)).withColumn("session", tp.session_date(local))
    real = fl.deduplicated(marked.filter("not is_ghost"))
    return real.join(mc.orphaned_closes(real, marked.filter("is_ghost")), "fill_id", "left_semi").select("fill_id", "account", "symbol", "session")


# Fills whose orders have no other side are paired first in, first out.
@query("parent_fallback_trips", _TRIPS, (v.ORDERS_LOG, "partly AS (SELECT *, CAST(timezone('America/New_York', timezone('UTC', ts)) + INTERVAL 7 HOUR AS DATE) AS session FROM orders_log WHERE fill_id % 5 <> 0)",
  "rest AS (SELECT * FROM partly ANTI JOIN (SELECT account, symbol, parent_id FROM partly GROUP BY ALL HAVING count(*) FILTER (open_close = 'OPEN') > 0 AND count(*) FILTER (open_close = 'CLOSE') > 0) USING (account, symbol, parent_id))", _LAID.format("rest")), "entry_price exit_price points")
def parent_fallback_trips(spark, d):
    f = v.orders_log(spark, d).filter("fill_id % 5 <> 0").withColumn("session", tp.session_date(tp.new_york(F.col("ts"))))
    return fl.fifo(mc.unmatched(f, mc.by_parent(f)))


_RET = "rt AS (SELECT date, (close / lag(close) OVER (ORDER BY date) - 1) * 100 AS ret FROM market), dp AS (SELECT account_name, CAST(entry_time AS DATE) AS date, sum(profit_loss) AS pnl FROM trades GROUP BY ALL)"


@query("market_ratios", """SELECT account_name, days, beta, alpha AS alpha_daily, alpha * 252 AS alpha_annual, error AS tracking_error, alpha * 252 / nullif(error, 0) AS information_ratio, (p * 252 - 0.02) / nullif(beta, 0) AS treynor FROM (
  SELECT *, p - 0.02 / 252 - beta * (m - 0.02 / 252) AS alpha FROM (
    SELECT account_name, count(*) AS days, any_value(b) AS beta, avg(pnl) AS p, avg(ret) AS m, stddev_pop(pnl - b * ret) * sqrt(252) AS error FROM (SELECT *, regr_slope(pnl, ret) OVER (PARTITION BY account_name) AS b FROM dp JOIN rt USING (date) WHERE ret IS NOT NULL) GROUP BY 1))""",
  (v.TRADES, v.MARKET, _RET), "beta alpha_daily alpha_annual tracking_error information_ratio treynor")
def market_ratios(spark, d):
    return mk.ratios(v.trades(spark, d), v.market(spark, d))


@query("diversification", """SELECT count(*) AS pairs, avg(r) AS mean_correlation, greatest(0, 1 - avg(r)) AS score, arg_max(pair, {'s': round(abs(r), 9), 'p': pair}) AS strongest, arg_min(pair, {'s': round(abs(r), 9), 'p': pair}) AS weakest, count(*) FILTER (r > 0.7) AS warnings FROM (
  SELECT x.account_name || '/' || y.account_name AS pair, coalesce(corr(x.pnl, y.pnl), 0) AS r FROM dp x JOIN dp y ON x.date = y.date AND x.account_name < y.account_name GROUP BY 1 HAVING count(*) >= 5)""",
  (v.TRADES, "dp AS (SELECT account_name, CAST(entry_time AS DATE) AS date, sum(profit_loss) AS pnl FROM trades GROUP BY ALL)"), "mean_correlation score")
def diversification(spark, d):
    return mk.diversification(mk.account_correlations(v.trades(spark, d)))


@query("calmar_ratios", """SELECT account_name, symbol, mean, deepest, mean / nullif(deepest, 0) AS calmar FROM (SELECT account_name, symbol, avg(profit_loss) AS mean, max(greatest(peak, 0) - equity) AS deepest FROM (
  SELECT *, max(equity) OVER w AS peak FROM (SELECT *, sum(profit_loss) OVER w AS equity FROM trades WINDOW w AS (PARTITION BY account_name, symbol ORDER BY entry_time, trade_id)) WINDOW w AS (PARTITION BY account_name, symbol ORDER BY entry_time, trade_id)) GROUP BY ALL)""", (v.TRADES,), "mean deepest calmar")
def calmar_ratios(spark, d):
    return mt.calmar(v.trades(spark, d), "account_name", "symbol")


@query("rolling_vote_quarter", """SELECT symbol, slot, dow, account_name, votes, share, CASE WHEN share >= 0.75 THEN 'High' WHEN share >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, slot, dow ORDER BY votes DESC, account_name) AS r FROM (
    SELECT *, votes / sum(votes) OVER (PARTITION BY symbol, slot, dow) AS share FROM (
      SELECT symbol, slot, dow, account_name, count(*) AS votes FROM (
        SELECT *, row_number() OVER (PARTITION BY w, symbol, slot, dow ORDER BY score DESC, account_name) AS k FROM (
          SELECT w, account_name, symbol, slot, dow, sum(profit_loss * pow(0.85, ago)) / sum(pow(0.85, ago)) AS score FROM (
            SELECT *, floor(date_diff('day', CAST(entry_time AS DATE), CAST((SELECT max(entry_time) FROM trades) AS DATE)) / 7) AS ago FROM trades), (SELECT unnest([1, 2, 4, 8, 13]) AS w)
          WHERE ago < w GROUP BY ALL HAVING count(*) >= 3)) WHERE k = 1 GROUP BY ALL))) WHERE r = 1""", (v.TRADES,), "share")
def rolling_vote_quarter(spark, d):
    return sl.rolling_vote(v.trades(spark, d), weeks=(1, 2, 4, 8, 13))


# Every fold's significant cells at a rate of 0.37 (the tables hold no strong cell).
@query("significant_walk_forward", """WITH span AS (SELECT min(CAST(entry_time AS DATE)) AS lo, max(CAST(entry_time AS DATE)) AS hi FROM daily),
  f AS (SELECT fold, lo + fold::INTEGER * 63 AS a, lo + fold::INTEGER * 63 + 252 AS b FROM (SELECT lo, unnest(range(0, (hi - lo - 252) // 63 + 1)) AS fold FROM span)),
  c AS (SELECT fold, account_name, symbol, slot, count(*) AS n, count(*) FILTER (profit_loss > 0) AS wins, sum(profit_loss) AS pnl FROM daily JOIN f ON CAST(entry_time AS DATE) >= a AND CAST(entry_time AS DATE) < b GROUP BY ALL HAVING count(*) >= 15),
  t AS (SELECT *, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) for i in range(wins, n + 1)]) AS p FROM c),
  q AS (SELECT *, least(min(p * m / k) OVER (PARTITION BY fold, account_name ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1.0) AS q FROM (SELECT *, count(*) OVER (PARTITION BY fold, account_name) AS m, row_number() OVER (PARTITION BY fold, account_name ORDER BY p, symbol, slot) AS k FROM t)),
  s AS (SELECT fold, account_name, symbol, slot FROM q WHERE q <= 0.37 AND 2 * wins >= n AND pnl > 0),
  e AS (SELECT fold, count(*) AS n, sum(profit_loss) AS total, count(*) FILTER (profit_loss > 0) / count(*) AS win_rate FROM daily d JOIN f ON CAST(entry_time AS DATE) >= b AND CAST(entry_time AS DATE) < b + 63 JOIN s USING (fold, account_name, symbol, slot) GROUP BY 1)
  SELECT fold, coalesce(tested, 0)::BIGINT AS tested, coalesce(cells, 0)::BIGINT AS cells, coalesce(n, 0)::BIGINT AS n, coalesce(total, 0.0)::DOUBLE AS total, win_rate
  FROM f LEFT JOIN (SELECT fold, count(*) AS tested FROM c GROUP BY 1) USING (fold) LEFT JOIN (SELECT fold, count(*) AS cells FROM s GROUP BY 1) USING (fold) LEFT JOIN e USING (fold)""", (v.DAILY,), "total win_rate")
def significant_walk_forward(spark, d):
    return en.significant_walk_forward(v.daily_trades(spark, d), ["symbol", "slot"], min_trades=15, rate=0.37)


@query("portfolio_weights")
def portfolio_weights(spark, d):
    trades = v.trades(spark, d)
    rows = [(m, a, round(w, 6)) for m in ("min_variance", "mean_variance", "risk_parity", "kelly") for a, w in op.weights(trades, m).items()]
    return spark.createDataFrame(rows, "method string, account_name string, weight double")


@query("forward_models")
def forward_models(spark, d):
    rows = ln.table(v.trades(spark, d), "account_name")
    return ln.forward_test(rows, "2024-01-21 00:00:00", ("linear", "forest")).select("model", "n", F.round("rmse", 6).alias("rmse"), F.round("hit_rate", 6).alias("hit_rate"))


def _bin_sql(where: str) -> str:
    """Metrics of an account's bins among some of its trades."""
    w = "(PARTITION BY account_name, slot ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT account_name, slot, count(*) AS n, count(*) FILTER (profit_loss > 0) AS wins, avg(profit_loss) AS mean, count(*) FILTER (profit_loss > 0) / count(*) AS win_rate, sum(profit_loss) FILTER (profit_loss > 0) / nullif(abs(sum(profit_loss) FILTER (profit_loss < 0)), 0) AS profit_factor,
      252 * avg(profit_loss) / nullif(stddev_samp(profit_loss) * sqrt(252), 0) AS sharpe, max(dd) AS worst_drop FROM (SELECT *, max(e) OVER {w} - e AS dd FROM (SELECT *, sum(profit_loss) OVER {w} AS e FROM trades WHERE {where})) GROUP BY 1, 2"""


_RECOMMENDED = f"""bm AS ({_bin_sql("entry_time < '2024-01-23'")}), later AS ({_bin_sql("entry_time >= '2024-01-23'")}),
  tb AS (SELECT *, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) for i in range(wins, n + 1)]) AS p FROM bm WHERE n >= 20),
  qb AS (SELECT *, least(min(p * m / k) OVER (PARTITION BY account_name ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1.0) AS q FROM (SELECT *, count(*) OVER (PARTITION BY account_name) AS m, row_number() OVER (PARTITION BY account_name ORDER BY p, slot) AS k FROM tb)),
  rated AS (SELECT b.account_name, b.slot, b.n, b.mean, b.win_rate, b.q, 0.4 * b.mean + 30.0 * b.win_rate + 2.0 * coalesce(b.sharpe, 0) + 0.5 * coalesce(b.profit_factor, 0) AS score,
    CASE WHEN q <= 0.37 AND b.n >= 100 THEN 'High' WHEN q <= 0.37 AND b.n >= 50 THEN 'Medium' ELSE 'Low' END AS confidence, CASE WHEN b.worst_drop > 10 * b.mean THEN 'High' WHEN b.worst_drop > 5 * b.mean THEN 'Medium' ELSE 'Low' END AS risk,
    CASE WHEN l.account_name IS NULL THEN 'pending' WHEN coalesce(l.sharpe > 0 AND l.worst_drop < greatest(3 * abs(b.mean), 300), false) THEN 'validated' ELSE 'failed' END AS status
    FROM qb b LEFT JOIN later l ON l.account_name = b.account_name AND l.slot = b.slot WHERE b.win_rate >= 0.4 AND b.mean >= 0),
  recommended AS (SELECT *, row_number() OVER (PARTITION BY account_name, status ORDER BY round(score, 6) DESC, slot) AS place FROM rated)"""


def _recommended(spark, d):
    t = v.trades(spark, d)
    cut = F.lit("2024-01-23").cast("timestamp_ntz")
    train, test = t.filter(F.col("entry_time") < cut), t.filter(F.col("entry_time") >= cut)
    return train, rc.bins(train, test, ["slot"], min_trades=20, min_win_rate=0.4, significant=False, rate=0.37, least_drop=300.0)


# Slots that were good until 23 January, and whether they still were afterwards.
@query("recommended_bins", "SELECT account_name, slot, n, mean, win_rate, q, score, confidence, risk, status, place FROM recommended", (v.TRADES, _RECOMMENDED), "mean win_rate q score")
def recommended_bins(spark, d):
    return _recommended(spark, d)[1]


@query("recommendation_summary", "SELECT account_name, bins, coalesce(met, 0) AS met, coalesce(validated, 0) AS validated, coalesce(pending, 0) AS pending, coalesce(failed, 0) AS failed FROM (SELECT account_name, count(DISTINCT slot) AS bins FROM bm GROUP BY 1) LEFT JOIN (SELECT account_name, count(*) AS met, count(*) FILTER (status = 'validated') AS validated, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed FROM recommended GROUP BY 1) USING (account_name)", (v.TRADES, _RECOMMENDED))
def recommendation_summary(spark, d):
    train, found = _recommended(spark, d)
    return rc.summary(train, found, ["slot"])


@query("quality_scores_weighted", """SELECT *, 0.25 * completeness + 0.3 * accuracy + 0.2 * consistency + 0.15 * timeliness + 0.1 * uniqueness AS score FROM (
  SELECT account_name, count(*) AS n, 100.0 * count(*) FILTER (entry_time IS NOT NULL AND exit_time IS NOT NULL AND profit_loss IS NOT NULL) / count(*) AS completeness, 100.0 * count(*) FILTER (abs(profit_loss) <= 10000 AND quantity > 0) / count(*) AS accuracy, 100.0 * count(*) FILTER (exit_time >= entry_time) / count(*) AS consistency,
    100.0 * count(DISTINCT (symbol, entry_time, exit_time, profit_loss)) / count(*) AS uniqueness, 100.0 * count(*) FILTER (entry_time >= (SELECT max(entry_time) FROM daily) - INTERVAL 730 DAY) / count(*) AS timeliness FROM daily GROUP BY 1)""", (v.DAILY,), "completeness accuracy consistency uniqueness timeliness score")
def quality_scores_weighted(spark, d):
    return mt.weighted_quality(v.daily_trades(spark, d))


@query("best_days", "SELECT account_name, dow, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY round(total, 6) DESC, dow) AS rank FROM (SELECT account_name, dow, sum(profit_loss) AS total FROM trades GROUP BY ALL)) WHERE rank <= 2", (v.TRADES,), "total")
def best_days(spark, d):
    by = v.trades(spark, d).groupBy("account_name", "dow").agg(F.sum("profit_loss").alias("total"))
    rank = F.row_number().over(Window.partitionBy("account_name").orderBy(F.desc(F.round("total", 6)), "dow"))
    return by.withColumn("rank", rank).filter("rank <= 2")


_BY = "(PARTITION BY account_name ORDER BY entry_time, trade_id)"


@query("drawdown_recoveries", f"""SELECT account_name, island, start, depth, trough, n, recovery FROM (SELECT *, lead(began) OVER (PARTITION BY account_name ORDER BY island) AS recovery FROM (
  SELECT account_name, island, min(entry_time) AS began, min(entry_time) FILTER (dd > 0) AS start, max(dd) AS depth, (min({{'d': -round(dd, 6), 't': entry_time, 'i': trade_id}}) FILTER (dd > 0)).t AS trough, count(*) FILTER (dd > 0) AS n FROM (
    SELECT *, sum(np) OVER {_BY} AS island FROM (SELECT *, (peak > coalesce(lag(peak) OVER {_BY}, 0))::INT AS np, peak - equity AS dd FROM (SELECT *, greatest(max(equity) OVER {_BY}, 0) AS peak FROM (SELECT *, sum(profit_loss) OVER {_BY} AS equity FROM trades)))) GROUP BY ALL)) WHERE n > 0""", (v.TRADES,), "depth")
def drawdown_recoveries(spark, d):
    return sr.drawdown_recoveries(v.trades(spark, d), "account_name")


@query("sequence_features", f"""SELECT trade_id, lead(profit_loss) OVER {_BY} AS next, count(*) OVER (PARTITION BY account_name, CAST(entry_time AS DATE) ORDER BY entry_time, trade_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS left_today, side = lag(side) OVER {_BY} AS same_side FROM trades""", (v.TRADES,), "next")
def sequence_features(spark, d):
    return sr.sequence_features(v.trades(spark, d), "account_name").select("trade_id", "next", "left_today", "same_side")
