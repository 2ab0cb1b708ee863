"""What queries do as tables grow: same results as a plain reckoning, without the step that grew faster than the input."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import edges as ed
from ledgerloom.operators import ensemble as en
from ledgerloom.operators import market as mk
from ledgerloom.operators import resample as rs
from ledgerloom.operators import scenarios as sc
from ledgerloom.operators import series as sr

START = dt.datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_band_matches_sort_no_pairs(spark):
    """Ties in time, price and both; cells that go over batches and goes of pairs; and no join of pairs in the plan."""
    rng = random.Random(3)
    rows = [(i, rng.choice("AB"), START + dt.timedelta(seconds=rng.randrange(0, 4000, 30)), rng.randrange(0, 60) / 4) for i in range(600)]
    rows += [(600, None, START, 1.0), (601, "A", START, None)]
    df = spark.createDataFrame(rows, "fill_id long, account string, ts timestamp, price double")
    left, right = df.filter("fill_id % 2 = 0"), df.filter("fill_id % 2 = 1")
    wanted = {}
    for i, a, t, p in rows:
        near = [(abs(int((t - u).total_seconds())), abs(p - q), j) for j, b, u, q in rows if i % 2 == 0 and j % 2 and a and a == b and p is not None and q is not None and abs((t - u).total_seconds()) <= 90 and abs(p - q) <= 2]
        if near:
            wanted[i] = (min(near)[2], min(near)[0], len(near))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = mk.band_matches(left, right)
        assert {r.fill_id: (r.r_id, r.gap, r.candidates) for r in found.collect()} == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "Join" not in plan(found)


def dated(spark, n=900):
    rng = random.Random(5)
    rows = [(i, rng.choice("AB"), rng.choice("XY"), rng.randrange(3), START + dt.timedelta(hours=17 * i), round(rng.gauss(2, 9), 2)) for i in range(n)]
    return spark.createDataFrame(rows, "trade_id long, account_name string, symbol string, slot int, entry_time timestamp_ntz, profit_loss double")


def test_month_folds_meet_days(spark):
    """the same as over trades, and folds and logics read no trade again."""
    trades, cell = dated(spark), ["symbol", "slot"]
    days = ed.cell_days(trades, cell)
    options = {"train": 3, "test": 2, "most": 1}
    found = ed.fold_metrics(ed.month_days(days, cell, **options))
    assert "profit_loss" not in plan(found) and "profit_loss" not in plan(ed.compared_logics(trades, cell, train=3, test=2))
    p = F.col("profit_loss")
    plain = ed.month_trades(trades, cell, **options).groupBy("fold").agg(F.count("*").alias("n"), F.sum(p), F.avg((p > 0).cast("double")), F.avg(p), F.stddev_samp(p), F.avg(p) / F.stddev_samp(p))
    a, b = sorted(map(tuple, found.collect())), sorted(map(tuple, plain.collect()))
    assert len(a) == len(b) > 3 and all(x == y or abs(x - y) < 1e-9 for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_profits_all_alike_have_no_sharpe(spark):
    trades = dated(spark).withColumn("profit_loss", F.lit(0.1))
    found = ed.fold_metrics(ed.month_days(ed.cell_days(trades, ["symbol"]), ["symbol"], train=3, test=2)).collect()
    assert found and all(r.volatility in (0.0, None) and r.sharpe is None for r in found)


def test_significant_folds_read_trades_once(spark):
    """F29."""
    assert "profit_loss" not in plan(en.significant_walk_forward(dated(spark), ["symbol"], min_trades=5, rate=0.9))


def test_features_have_no_window_over_an_account(spark):
    """windows run within days, and each day begins with the trades before it, over empty and short days too."""
    trades = dated(spark, 200).withColumn("entry_time", F.expr("entry_time - make_dt_interval(0, 15 * trade_id, 0, 0) + make_dt_interval(trade_id div 40 * 3)"))
    got = {r.trade_id: r for r in sr.features(trades, "account_name").collect()}
    w = Window.partitionBy("account_name").orderBy("entry_time", "trade_id")
    p = F.col("profit_loss")
    plain = trades.select("trade_id", F.lag(p).over(w).alias("prev"), (p - F.lag(p).over(w)).alias("change"), F.avg(p).over(w.rowsBetween(-5, -1)).alias("mean5"), (F.lag(p).over(w) - F.lag(p, 2).over(w)).alias("prev_change"), F.row_number().over(Window.partitionBy("account_name", F.to_date("entry_time")).orderBy("entry_time", "trade_id")).alias("nth_today")).collect()
    assert len(got) == len(plain) == 200
    for r in plain:
        assert all(getattr(got[r.trade_id], c) == r[c] or abs(getattr(got[r.trade_id], c) - r[c]) < 1e-9 for c in ("prev", "change", "mean5", "prev_change", "nth_today"))
    assert "windowspecdefinition(account_name" not in plan(sr.features(trades, "account_name"))


def test_permutations_take_no_digest_a_trade(spark):
    """one digest a trade gives its place; those of permutations are of accounts."""
    trades = dated(spark).withColumn("hour", F.col("slot"))
    assert plan(rs.selected_by_luck(trades, "account_name", ["hour"], perms=5)).count("md5") == plan(rs.places(trades, "account_name", "trade_id", 42)).count("md5")


def test_weights_of_resamples(spark):
    """the weights of digests as text are those of the uniform draws, and no digest becomes a number."""
    got = rs.weighted(spark.range(300), "id", 20, 42)
    assert "conv(" not in plan(got)
    both = got.select("_w", rs.poisson_weight(sc.uniform(F.lit(42), F.col("id"), F.col("sim"))).alias("w")).collect()
    assert len(both) == 6000 and all(r.w == r["_w"] for r in both)
