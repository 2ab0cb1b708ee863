"""Operators on small frames with known results."""

import math
import random
from datetime import datetime, timedelta

import pytest

from ledgerloom.functions import stats
from ledgerloom.functions import timeplane as tp
from ledgerloom.operators import fills as fl
from ledgerloom.operators import series as sr
from ledgerloom.operators import validation as vd
from ledgerloom.sources import activity_log as al
from ledgerloom.streaming import monitor as mo

T0 = datetime(2024, 1, 2, 15, 0)


def test_distribution_functions():
    assert math.isclose(stats.t_two_sided(2.228, 10), 0.05, abs_tol=2e-4)
    assert math.isclose(stats.t_two_sided(12.706, 1), 0.05, abs_tol=1e-4)
    assert math.isclose(stats.f_upper(4.10, 2, 10), 0.05, abs_tol=2e-4)
    assert math.isclose(stats.beta_cdf(2, 3, 0.4), 0.5248, abs_tol=1e-9)


def test_session_and_window(spark):
    rows = [(datetime(2024, 1, 5, 21, 55), datetime(2024, 1, 5, 22, 5)), (datetime(2024, 1, 5, 22, 1), datetime(2024, 1, 5, 22, 30))]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp")
    got = df.select(tp.crosses_close(tp.new_york(df.a), tp.new_york(df.b)).alias("x")).collect()
    assert [r.x for r in got] == [True, False]
    minutes = spark.createDataFrame([(5,), (1415,), (700,)], "m int")
    assert [r[0] for r in minutes.select(tp.in_window(minutes.m, 1410, 30)).collect()] == [True, True, False]


def queue(rows):
    """First in, first out, lot by lot."""
    held, out = [], []
    for ts, i, side, n, price in sorted(rows):
        for _ in range(n):
            if held and held[0][0] != side:
                first = held.pop(0)
                out.append((("LONG" if first[0] == "BUY" else "SHORT"), first[1], ts, first[2], price))
            else:
                held.append((side, ts, price))
    return sorted(out)


def test_fifo_equals_a_queue(spark):
    r = random.Random(9)
    rows = [(T0 + timedelta(seconds=r.randrange(400)), i, r.choice(["BUY", "SELL"]), r.randrange(1, 40), float(r.randrange(90, 110))) for i in range(120)]
    df = spark.createDataFrame([("A", "NQ", "s", *x) for x in rows], "account string, symbol string, session string, ts timestamp, fill_id long, side string, quantity int, price double")
    got = sorted((t.direction, t.entry_time, t.exit_time, t.entry_price, t.exit_price) for t in fl.fifo(df).collect() for _ in range(t.quantity))
    assert got == queue(rows)


def test_adjusted_p(spark):
    ps = [0.01, 0.04, 0.03, None, 0.5]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(ps)], "f int, id int, p double")
    got = {r.id: r.q for r in sr.adjusted_p(df, ["f"]).collect()}
    want = {0: 0.04, 1: 0.04 * 4 / 3, 2: 0.04 * 4 / 3, 4: 0.5}
    assert got[3] is None and all(math.isclose(got[k], v) for k, v in want.items())


def test_folds_are_disjoint_and_cover(spark):
    df = spark.createDataFrame([(T0,), (T0 + timedelta(days=100),)], "entry_time timestamp")
    f = sorted(map(tuple, vd.folds(df, 30, 10).collect()))
    assert len(f) == 8 and all(a[4] == b[3] for a, b in zip(f, f[1:], strict=False)) and all(x[2] == x[3] for x in f)


def test_log_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Time\tQty\tPrice\n2024-01-02  15:00:00 BP\t1,000\t1.5\textra\n01/02/2024 15:00:01\t1.0\n\nbad\tx\t2%\n")
    df = al.typed(al.read(spark, str(tmp_path), ["Time", "Qty", "Price"]), ["Time"], ["Qty"], ["Price"])
    got = sorted(((r.Time, r.Qty, r.Price, r.problems) for r in df.collect()), key=str)
    assert got == [(None, None, 2.0, ["Time", "Qty"]), (T0, 1000, 1.5, []), (T0 + timedelta(seconds=1), 1, None, [])] or sorted(map(str, got)) == sorted(map(str, [(None, None, 2.0, ["Time", "Qty"]), (T0, 1000, 1.5, []), (T0 + timedelta(seconds=1), 1, None, [])]))


@pytest.mark.parametrize("which", ["snapshots", "sessions"])
def test_stream_equals_batch(spark, tmp_path, which):
    rows = [(i, "A" if i % 3 else "B", "NQ", T0 + timedelta(minutes=7 * i + 60 * (i // 10)), float(i % 5 - 2)) for i in range(200)]
    schema = "trade_id long, account_name string, symbol string, entry_time timestamp, profit_loss double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    make = getattr(mo, which)
    stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete" if which == "snapshots" else "append").format("memory").queryName(f"out_{which}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = sorted(map(tuple, make(spark.read.parquet(str(tmp_path / "in"))).collect()))
    got = sorted(map(tuple, spark.table(f"out_{which}").collect()))
    assert got == batch if which == "snapshots" else set(got) <= set(batch) and len(got) > 0


def test_models_and_weights(spark):
    from ledgerloom.operators import learn, optimize

    r = random.Random(1)
    rows = [(i, "AB"[i % 2], T0 + timedelta(hours=5 * i), r.gauss(1, 1 if i % 2 else 3), (5 * i) % 24) for i in range(300)]
    df = spark.createDataFrame(rows, "trade_id long, account_name string, entry_time timestamp, profit_loss double, hour int")
    got = learn.forward_test(learn.table(df, "account_name"), "2024-02-15 00:00:00", ("linear",)).collect()
    assert got[0].n > 50 and got[0].rmse < 4
    w = optimize.weights(df)
    assert math.isclose(sum(w.values()), 1, abs_tol=1e-6) and w["B"] > w["A"] > 0
    p = optimize.weights(df, "risk_parity")
    assert math.isclose(sum(p.values()), 1, abs_tol=1e-6) and p["B"] > p["A"] > 0


def test_cooldown(spark, tmp_path):
    from ledgerloom.streaming.cooldown import losing_streaks

    rows = [("A", T0 + timedelta(minutes=i), -1.0) for i in range(12)] + [("B", T0 + timedelta(minutes=i), 1.0 - i % 2) for i in range(12)]
    schema = "account_name string, event_time timestamp, profit_loss double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    out = losing_streaks(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 5, 300.0)
    q = out.writeStream.outputMode("append").format("memory").queryName("streaks_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.account_name, r.streak) for r in spark.table("streaks_out").collect()) == [("A", 5), ("A", 10)]


def test_orphaned_closes_follow_ghosts(spark):
    from ledgerloom.operators import matching as mc

    schema = "account string, symbol string, session string, fill_id long, ts timestamp, side string, quantity int, open_close string"
    rows = [("A", "NQ", "s", i, T0 + timedelta(seconds=i), side, n, kind) for i, (side, n, kind) in enumerate([("SELL", 1, "CLOSE"), ("BUY", 2, "OPEN"), ("SELL", 2, "CLOSE"), ("SELL", 1, "CLOSE"), ("SELL", 1, "OPEN"), ("BUY", 1, "CLOSE")])]
    rows += [("B", "NQ", "s", 10, T0, "SELL", 1, "CLOSE")]  # no ghost was removed here, so the close stays
    ghosts = spark.createDataFrame([("A", "NQ", "s")], "account string, symbol string, session string")
    got = mc.orphaned_closes(spark.createDataFrame(rows, schema), ghosts).collect()
    assert sorted(r.fill_id for r in got) == [0, 3]


def test_sign_flip_equals_a_plain_count(spark):
    from pyspark.sql import functions as F

    values = [(i, x) for i, x in enumerate([1.0, -0.5, 2.0, 0.7, -0.1, 1.3])]
    df = spark.createDataFrame(values, "id long, value double")
    signs = spark.range(200).withColumnRenamed("id", "perm").crossJoin(df.select("id")).select("perm", "id", vd.flip(42).alias("s")).collect()
    means = {}
    for r in signs:
        means[r.perm] = means.get(r.perm, 0) + r.s * abs(values[r.id][1]) / len(values)
    seen = sum(x for _, x in values) / len(values)
    want = sum(abs(m) >= abs(seen) - 1e-12 for m in means.values()) / 200
    got = vd.sign_flip(df.repartition(3), 200).first()
    assert math.isclose(got.observed, seen) and math.isclose(got.p, want)
    assert F is not None and 0.02 < want < 0.4


def test_bootstrap_equals_a_plain_walk(spark):
    from ledgerloom.operators import simulate as sm

    r = random.Random(4)
    rows = [(i, "AB"[i % 2], T0 + timedelta(minutes=i), r.gauss(1, 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "trade_id long, account_name string, entry_time timestamp, profit_loss double")
    pool = {k: [p for _, a, _, p in rows if a == k] for k in "AB"}
    grid = spark.createDataFrame([(k, s, t, len(pool[k])) for k in "AB" for s in range(20) for t in range(7)], "account_name string, sim long, step int, n long")
    drawn = {(x.account_name, x.sim, x.step): x.i for x in grid.withColumn("i", sm.draw("account_name", "n", 42)).collect()}
    got = {(x.account_name, x.sim): (x.final, x.max_drop) for x in sm.paths(df, "account_name", 20, 7).collect()}
    for k in "AB":
        for s in range(20):
            equity = peak = drop = 0.0
            for t in range(7):
                equity += pool[k][drawn[k, s, t]]
                peak = max(peak, equity)
                drop = max(drop, peak - equity)
            assert math.isclose(got[k, s][0], equity, abs_tol=1e-9) and math.isclose(got[k, s][1], drop, abs_tol=1e-9)
    assert len(got) == 40


def test_anchored_folds_and_drawdown_without_floor(spark):
    df = spark.createDataFrame([(T0,), (T0 + timedelta(days=100),)], "entry_time timestamp")
    f = sorted(map(tuple, vd.folds(df, 30, 10, anchored=True).collect()))
    assert len({x[1] for x in f}) == 1 and [x[2] for x in f] == sorted({x[2] for x in f})
    t = spark.createDataFrame([(i, "A", T0 + timedelta(minutes=i), p) for i, p in enumerate([-2.0, 1.0, -3.0])], "trade_id long, account_name string, entry_time timestamp, profit_loss double")
    assert [r.drawdown for r in sr.drawdown(t, "account_name", floor=False).orderBy("trade_id").collect()] == [0.0, 0.0, 3.0]
    assert [r.drawdown for r in sr.drawdown(t, "account_name").orderBy("trade_id").collect()] == [2.0, 1.0, 4.0]


def test_an_equity_back_at_its_peak_is_no_drop(spark):
    profits = [0.3, -0.1, -0.2, 0.3, 0.5]  # in doubles the fourth sum is less than the first
    t = spark.createDataFrame([(i, "A", T0 + timedelta(minutes=i), p) for i, p in enumerate(profits)], "trade_id long, account_name string, entry_time timestamp, profit_loss double")
    for f in (sr.drawdown_periods, sr.drawdown_recoveries):
        (r,) = f(t, "account_name").collect()
        assert (r.island, r.depth, r.n) == (1, 0.3, 2)


def test_known_rows_are_not_imported_again(spark):
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k long, v string")
    got = al.new_only(new, spark.createDataFrame([(2,)], "k long"), ["k"]).collect()
    assert sorted(r.k for r in got) == [1, 3]


def test_repeats_within_the_watermark_come_once(spark, tmp_path):
    schema = "fill_id long, ts timestamp"
    spark.createDataFrame([(1, T0), (1, T0 + timedelta(minutes=1)), (2, T0)], schema).write.parquet(str(tmp_path / "in"))
    q = mo.once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["fill_id"]).writeStream.format("memory").queryName("once_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.fill_id for r in spark.table("once_out").collect()) == [1, 2]
    assert mo.once(spark.read.schema(schema).parquet(str(tmp_path / "in")), ["fill_id"]).count() == 2
