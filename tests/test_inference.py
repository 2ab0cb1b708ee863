"""Rank tests, positions, strategies and files against plain versions on small frames."""

import math
import random
from datetime import datetime, timedelta

import pytest

from ledgerloom.functions import stats
from ledgerloom.operators import positions as po
from ledgerloom.operators import ranks as rk
from ledgerloom.operators import significance as sg
from ledgerloom.operators import strategies as st
from ledgerloom.sources import files as fi

T0 = datetime(2024, 1, 2, 15, 0)


def test_quantiles_and_tails():
    assert math.isclose(stats.t_quantile(0.95, 10), 2.228139, abs_tol=1e-5)
    assert math.isclose(stats.t_quantile(0.99, 3), 5.840909, abs_tol=1e-5)
    assert math.isclose(stats.binomial_upper(8, 10), 56 / 1024) and stats.binomial_upper(0, 4) == 1.0


def test_intervals_hold_the_mean(spark):
    df = spark.createDataFrame([("A", float(x)) for x in (1, 2, 3, 4, 5)], "k string, profit_loss double")
    r = sg.intervals(df, "k").first()
    assert math.isclose(r.low, 3 - 2.776445 * math.sqrt(2.5 / 5), abs_tol=1e-4) and math.isclose(r.low + r.high, 6)


@pytest.mark.parametrize("bins", [1, 3, 1024])
def test_places_equal_sorted_places(spark, bins):
    r = random.Random(bins)
    rows = [(k, r.choice([r.gauss(0, 5), float(r.randrange(-2, 3))])) for k in "AAB" for _ in range(40)] + [("C", 1.0), ("C", 1.0), ("D", None)]
    got = {(x.k, x.v): (x.ties, x.place) for x in rk.places(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", bins).collect()}
    for k in "ABC":
        values = sorted(v for j, v in rows if j == k)
        for v in set(values):
            at = [i + 1 for i, x in enumerate(values) if x == v]
            assert got[k, v] == (len(at), sum(at) / len(at))
    assert not any(k == "D" for k, _ in got)


def plain_ledger(rows):
    """Position, average price and realised points, fill by fill."""
    position, average, out = 0, None, {}
    for _, i, side, n, price in sorted(rows):
        q, won = n if side == "BUY" else -n, 0.0
        if position * q < 0:
            shut = min(abs(q), abs(position))
            won = shut * (price - average) * (1 if position > 0 else -1)
            after = position + q
            average = None if after == 0 else average if after * position > 0 else price
        else:
            average = price if position == 0 else (average * abs(position) + price * n) / (abs(position) + n)
        position += q
        out[i] = (position, average, won)
    return out


def test_ledger_equals_a_walk(spark):
    r = random.Random(3)
    rows = [(T0 + timedelta(seconds=r.randrange(300)), i, r.choice(["BUY", "SELL"]), r.randrange(1, 6), float(r.randrange(90, 110))) for i in range(400)]
    df = spark.createDataFrame([("A", "NQ", "s", *x) for x in rows], "account string, symbol string, session string, ts timestamp, fill_id long, side string, quantity int, price double")
    want = plain_ledger(rows)
    for g in po.ledger(df.repartition(3)).collect():
        position, average, won = want[g.fill_id]
        assert g.position == position and math.isclose(g.realised, won, abs_tol=1e-6)
        assert g.average_price is None if average is None else math.isclose(g.average_price, average, rel_tol=1e-9)


def test_strategies_on_empty_tables(spark):
    empty = spark.createDataFrame([], "account_name string, symbol string, entry_time timestamp_ntz, profit_loss double")
    said = st.verdicts(empty, ["account_name"])
    assert st.vote(said, ["account_name"]).count() == 0 and st.evaluated(empty, said, ["account_name"]).count() == 0
    assert st.retained(empty, "entry_time", "1 HOUR").count() == 0 and rk.tails(empty, "account_name").count() == 0


def test_alerts_that_last(spark):
    marks = [1, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([("A", T0 + timedelta(hours=i), m) for i, m in enumerate(marks)], "k string, start timestamp, m int")
    got = sorted((x.since, x.until, x.snapshots, x.resolved) for x in st.sustained(df, df.m == 1, "2 HOURS", "k").collect())
    assert got == [(T0 + timedelta(hours=3), T0 + timedelta(hours=5), 3, None)]


def test_files_are_found(spark, tmp_path):
    for name in ("log_2024-01-05_ACC1.txt", "log_2024-02-01_acc1.txt", "log_2024-02-02_ACC2.txt", "other.csv"):
        (tmp_path / name).write_text("x")
    got = [r.name for r in fi.discovered(spark, str(tmp_path), glob="*.txt", since="2024-01-31", account="Acc1").collect()]
    assert got == ["log_2024-02-01_acc1.txt"]
    assert [str(r.file_date) for r in fi.discovered(spark, str(tmp_path), glob="log*").collect()] == ["2024-01-05", "2024-02-01", "2024-02-02"]


def test_merge_backup_and_export(spark, tmp_path):
    known = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (None, "N")], "k long, v string")
    assert sorted(map(str, fi.merged(known, new, ["k"]).collect())) == sorted(map(str, spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (None, "N")], known.schema).collect()))
    rest = fi.removed_with_backup(known, known.k == 1, str(tmp_path / "b"), str(tmp_path / "r"))
    assert sorted(r.v for r in rest.collect()) == ["b", "n"] and [r.v for r in spark.read.parquet(str(tmp_path / "b")).collect()] == ["a"]
    for kind in ("csv", "json", "parquet"):
        fi.exported(known, str(tmp_path / kind), kind, files=1)
        read = spark.read.schema(known.schema).option("header", "true").format(kind).load(str(tmp_path / kind))
        assert sorted(map(str, read.collect())) == sorted(map(str, known.collect()))
    with pytest.raises(ValueError, match="no export"):
        fi.exported(known, str(tmp_path / "x"), "xlsx")


def test_cleaner_goes_on_where_it_stopped(spark, tmp_path):
    src, out, audit, mark = (str(tmp_path / x) for x in ("in", "out", "audit", "mark"))
    (tmp_path / "in").mkdir()

    def run():
        q = fi.cleaned(spark, src, "id long, profit_loss double", lambda df: df.filter("abs(profit_loss) < 1000"), out, audit, mark, files_at_once=1)
        q.awaitTermination()

    (tmp_path / "in" / "a.csv").write_text("id,profit_loss\n1,600\n2,5\n")
    (tmp_path / "in" / "b.csv").write_text("id,profit_loss\n3,5000\n4,7\n")
    run()
    (tmp_path / "in" / "c.csv").write_text("id,profit_loss\n5,9000\n")
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 4]
    got = sorted((r.file[-5:], r.rows_before, r.rows_after, r.flagged) for r in spark.read.parquet(audit).collect())
    assert got == [("a.csv", 2, 2, False), ("b.csv", 2, 1, True), ("c.csv", 1, 0, True)]
