"""Scans over blocks against plain walks."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators import positions as po
from ledgerloom.operators import scans
from ledgerloom.operators import series as sr

from .test_inference import plain_ledger

T0 = datetime(2024, 1, 2, 15, 0)


def trades(seed, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + timedelta(hours=r.choice([r.uniform(0, 400), 24.0 * r.randrange(12)]))
        rows.append((i, r.choice(["A", "A", "A", None]), at, at, r.choice([r.gauss(0, 10), 0.0, None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "trade_id long, account_name string, entry_time timestamp, exit_time timestamp, profit_loss double").repartition(5)


def test_running_sums_and_peaks(spark):
    rows = trades(1)
    got = {x.trade_id: x for x in sr.drawdown(frame(spark, rows), "account_name").collect()}
    assert len(got) == len(rows)
    for key in ("A", None):
        equity = peak = 0.0
        for i, _, _, _, p in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            equity += p or 0.0
            peak = max(peak, equity)
            assert math.isclose(got[i].equity, equity, abs_tol=1e-9) and math.isclose(got[i].drawdown, peak - equity, abs_tol=1e-9)


def plain_drops(rows, days):
    out = {}
    for i, key, _, at, _ in rows:
        frame_ = sorted((r for r in rows if r[1] == key and r[3] >= at - timedelta(days=days) and (r[3], r[0]) <= (at, i)), key=lambda r: (r[3], r[0]))
        equity = peak = drop = 0.0
        for r in frame_:
            equity += r[4] or 0.0
            peak = max(peak, equity)
            drop = max(drop, peak - equity)
        out[i] = (len(frame_), equity, drop)
    return out


def test_drops_within_days(spark):
    for days in (1, 2, 7):
        rows = trades(days)
        want = plain_drops(rows, days)
        got = {x.trade_id: (x.n_window, x.pnl_window, x.drop_window) for x in sr.rolling_drops(frame(spark, rows), days, "account_name", least=1).collect()}
        assert got.keys() == want.keys()
        assert all(all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[i], want[i], strict=True)) for i in want)
    assert sr.rolling_drops(frame(spark, rows[:0]), 3, "account_name").collect() == []


def test_one_long_account_is_many_tasks(spark):
    """Rows meet in windows by block only; the one window by account is over a summary a day."""
    plan = sr.rolling_drops(frame(spark, trades(2)), 30, "account_name")._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "windowspecdefinition(" in x and "Window [" in x]
    assert len(windows) >= 5 and all("windowspecdefinition(_at#" in x or "collect_list" in x for x in windows)


def test_ledger_of_a_run_that_never_is_flat(spark):
    """10,000 fills without a flat position: costs are scaled thousands of times."""
    r = random.Random(4)
    rows, position = [], 0
    for i in range(10_000):
        n = 2 if i == 0 else r.randint(1, 3)
        side = "BUY" if position <= n or (r.random() < 0.5 and position < 40) else "SELL"
        position += n if side == "BUY" else -n
        assert position > 0
        rows.append((T0 + timedelta(seconds=2 * i), i, side, n, 100 + r.uniform(-5, 5)))
    df = spark.createDataFrame([(t, i, s, n, p, "A", "NQ", T0.date()) for t, i, s, n, p in rows], "ts timestamp, fill_id long, side string, quantity int, price double, account string, symbol string, session date")
    want = plain_ledger(rows)
    got = {g.fill_id: g for g in po.ledger(df.repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, (position, average, won) in want.items():
        assert got[i].position == position and math.isclose(got[i].average_price, average, rel_tol=1e-9) and math.isclose(got[i].realised, won, abs_tol=1e-7)


def test_affine_scan_holds_tiny_scales(spark):
    r = random.Random(9)
    rows = [(i, T0 + timedelta(minutes=i), r.choice([1.0, 1e-9, 0.5, 1e-120, 0.0 if r.random() < 0.02 else 1.0]), r.choice([0.0, r.uniform(0, 5)])) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, ts timestamp, a double, b double").repartition(3)
    got = {x.i: x.value for x in scans.affine(df, [], ["i"], F.date_trunc("hour", "ts"), F.col("a"), F.col("b")).collect()}
    x = 0.0
    for i, _, a, b in rows:
        x = a * x + b
        assert math.isclose(got[i], x, rel_tol=1e-9, abs_tol=1e-100)  # what is two cuts of e^-300 away counts as nothing


def test_no_frame_runs_on_to_the_end(spark):
    """Spark sums a frame from a row to the end of its partition anew for every row, so time grew with the square of a day's trades."""
    df = frame(spark, trades(3)).withColumn("side", F.lit("LONG"))
    for made in (sr.rolling_drops(df, 3, "account_name"), sr.sequence_features(df, "account_name")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "windowspecdefinition(" in plan and ", unboundedfollowing$()" not in plan.replace("unboundedpreceding$(), unboundedfollowing$()", "")
    got = {x.trade_id: x.left_today for x in sr.sequence_features(df, "account_name").collect()}
    for i, key, at, _, _ in trades(3):
        assert got[i] == sum(r[1] == key and r[2].date() == at.date() and (r[2], r[0]) > (at, i) for r in trades(3))
