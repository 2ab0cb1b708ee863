"""Fills of events written as tagged logs and read back; damaged files."""

import struct
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.plans import views as v
from ledgerloom.sources import tagged_log as tl

SF = "/root/testdata/sf0.001"
EPOCH = datetime(1970, 1, 1)


def tagged(tag, value):
    return struct.pack("<II", tag, len(value)) + value


def encoded(fill, k):
    """A fill as a record: time, symbol, order, side, message, quantity, price; every third as another kind of time."""
    us = (fill.ts - EPOCH) // timedelta(microseconds=1)
    time = struct.pack("<q", us) if k % 3 else struct.pack("<q", us + 25_569 * 86_400_000_000)
    out = tagged(102, time) + tagged(103, fill.symbol.encode()) + tagged(100, str(fill.fill_id).encode()) + tagged(109, bytes([1 if fill.side == "BUY" else 2])) + tagged(112, b"\x08")
    if fill.note:
        out += tagged(130, fill.note.encode())
    out += tagged(104, f"Trade simulation fill. Bid: 1 Ask: 2 Last: 3 filler {'x' * (k % 50)}".encode())
    return out + tagged(114, struct.pack("<d", fill.quantity)) + tagged(113, struct.pack("<d", fill.price)) + tagged(120, b"\x02" if fill.open_close == "CLOSE" else b"\x01")


def written(spark, folder):
    rows = v.fills(spark, SF).orderBy("ts", "fill_id").collect()
    by_account = {}
    for r in rows:
        by_account.setdefault(r.account, []).append(r)
    for a, held in by_account.items():
        # One fill a moment, as events of one file and time are one.
        held = list({r.ts: r for r in held}.values())
        by_account[a] = held
        (folder / f"Activity.{a}_UTC.data").write_bytes(b"".join(encoded(r, k) for k, r in enumerate(held)))
    return [r for held in by_account.values() for r in held]


def shown(rows):
    return sorted((r.account, r.symbol, str(r.ts), r.side, round(r.price, 6), r.quantity, r.note, r.open_close) for r in rows)


def test_fills_come_back_whatever_the_ranges(spark, tmp_path):
    rows = written(spark, tmp_path)
    for split in (32 << 20, 5000, 777):
        logs = tl.read(spark, str(tmp_path), split)
        got = tl.fills(logs)
        assert shown(got.collect()) == shown(rows)
        assert logs.filter("problem is not null").count() == 0
    assert tl.read(spark, str(tmp_path), 5000).rdd.getNumPartitions() > 20
    ids = {r.order_id for r in tl.fills(tl.read(spark, str(tmp_path))).collect()}
    assert ids == {str(r.fill_id) for r in rows}


def test_a_cut_tail_and_a_damaged_middle_are_counted(spark, tmp_path):
    rows = [r for r in v.fills(spark, SF).orderBy("ts", "fill_id").limit(40).collect()]
    parts = [encoded(r, k) for k, r in enumerate(rows)]
    parts[10] = parts[10][:60] + b"\x00" * 33 + b"\xff" * 20  # a stretch that is no tag
    (tmp_path / "x.A.data").write_bytes(b"".join(parts)[:-5])
    logs = tl.read(spark, str(tmp_path))
    assert logs.count() == 40
    problems = {r.problem for r in logs.filter("problem is not null").collect()}
    assert "cut off" in problems and any(p.startswith("skipped") for p in problems)
    assert {r.order_id for r in tl.fills(logs).collect()} >= {str(r.fill_id) for k, r in enumerate(rows[:-1]) if k != 10}


def test_times_are_told_apart_by_range(spark):
    at = datetime(2025, 12, 18, 21, 55)
    us = (at - EPOCH) // timedelta(microseconds=1)
    days = (at - datetime(1899, 12, 30)) / timedelta(days=1)
    rows = [(days, struct.unpack("<q", struct.pack("<d", days))[0])] + [(struct.unpack("<d", struct.pack("<q", x))[0], x) for x in (us, us + 25_569 * 86_400_000_000, us // 1000, 17)]
    df = spark.createDataFrame(rows, "d double, l long").select(F.date_format(tl.time_of(F.col("d"), F.col("l")), "yyyy-MM-dd HH:mm:ss").alias("t"))
    assert [r.t for r in df.collect()] == ["2025-12-18 21:55:00"] * 4 + [None]


def test_rules_of_events(spark, tmp_path):
    at = lambda s: tagged(102, struct.pack("<q", 1_766_000_000_000_000 + s * 1_000_000))
    say = lambda t: tagged(104, t.encode())
    order = lambda i: tagged(100, i.encode())
    data = tagged(103, b"NQH26")
    data += at(1) + order("a") + say("Trade simulation fill. Buy Bid: 10 Ask: 11 qty: 3")
    data += at(2) + order("b") + say("Trade simulation fill. sold Bid: 10.5 Ask: 11")
    data += at(3) + order("c") + say("Trade simulation fill. Bid: 10 Ask: 11")  # no side
    data += at(4) + order("d") + say("Trade simulation fill. bought at price 12") + tagged(112, b"\x05")  # not filled
    data += at(5) + order("e") + say("Trade simulation fill. bought, ask 9") + tagged(107, b"Limit")  # a resting order's update
    data += at(6) + order("f") + say("Trading Evaluator (Filled). bought") + tagged(107, b"Stop") + tagged(113, struct.pack("<d", 8.0))
    data += at(7) + order("g") + say("Trade simulation fill. bought, ask 9")
    data += at(8) + order("g") + say("Internally marking as canceled")
    data += at(9) + order("i") + say("Trade simulation fill. Bid: 1 Ask: 2")
    data += at(9) + say("Updated Internal Position Quantity to -3. Previous: 1. Fill of InternalOrderID: 77")
    data += at(10) + tagged(105, struct.pack("<q", 5)) + say("Trade simulation fill. sold, bid 4") + tagged(125, struct.pack("<d", -1.0))
    data += at(11) + say("Updated Internal Position Quantity to 0. Previous: -3. Fill of InternalOrderID: 5")
    (tmp_path / "log.V_9.data").write_bytes(data)
    got = {(r.order_id or r.side): (r.side, r.price, r.quantity, r.position_order, r.account, r.symbol) for r in tl.fills(tl.read(spark, str(tmp_path))).collect()}
    assert got == {
        "a": ("BUY", 11.0, 3, 999_999, "V_9", "NQH26"),
        "b": ("SELL", 10.5, 1, 999_999, "V_9", "NQH26"),
        "f": ("BUY", 8.0, 1, 999_999, "V_9", "NQH26"),
        "77": ("SELL", 1.0, 4, 0, "V_9", "NQH26"),
        "SELL": ("SELL", 4.0, 1, 1, "V_9", "NQH26"),
    }
