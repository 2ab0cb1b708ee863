from datetime import datetime

from ledgerloom.sources import trade_list as tr

HEAD = "Symbol\tTrade Type\tEntry DateTime\tExit DateTime\tEntry Price\tExit Price\tTrade Quantity\tMax Open Quantity\tProfit/Loss (C)\tCumulative Profit/Loss (C)\tDuration\tCommission (C)\tAccount\tNote"
GOOD = "CLG26 (3Q_sim14)\tLong\t2026-01-19  09:30:33.000 BP\t2026-01-19  10:02:45.000\t59.28\t59.48\t1\t3\t1,195.80\t9\t00:32:12\t4.20\t98.2%\tgrün"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_columns_are_found_by_name(spark):
    r = one(tr.trades(tr.pasted(spark, f"\n{HEAD}\r\n\r\n{GOOD}\r\n")))
    assert (r.symbol, r.account, r.side, r.quantity, r.profit_loss, r.commission, r.duration, r.note) == ("CLG26", "3Q_sim14", "LONG", 1, 1195.8, 4.2, 1932, "grün")
    assert (r.entry_time, r.exit_time, r.entry_price, r.exit_price) == (datetime(2026, 1, 19, 9, 30, 33), datetime(2026, 1, 19, 10, 2, 45), 59.28, 59.48)
    assert r.problems == [] and r.line == 2
    moved = "Note\tP/L\tSymbol\tEntry DateTime\tQuantity\nhi\t$-5\tES\t2026-01-19 09:30:33\t2.0"
    r = one(tr.trades(tr.pasted(spark, moved)))
    assert (r.note, r.profit_loss, r.symbol, r.quantity, r.problems) == ("hi", -5.0, "ES", 2, [])


def test_lists_without_a_header_and_bad_lines(spark):
    plain = "ES\tShort\t2026-01-19 09:30:33\t10\t2026-01-19 09:31:33\t11\t2\t\t\t-50\t\t4"
    r = one(tr.trades(tr.pasted(spark, plain)))
    assert (r.side, r.entry_price, r.exit_price, r.quantity, r.profit_loss, r.commission, r.note) == ("SHORT", 10.0, 11.0, 2, -50.0, 4.0, None)
    bad = one(tr.trades(tr.pasted(spark, "\tLong\tnever\t10\t\tx\t2")))
    assert set(bad.problems) == {"symbol", "entry_time", "exit_price"}
    assert tr.trades(tr.pasted(spark, "")).collect() == [] and tr.trades(tr.pasted(spark, "word")).collect() == []


def test_encodings(spark, tmp_path):
    for name, code in (("a", "utf-8"), ("b", "utf-8-sig"), ("c", "cp1252"), ("d", "utf-16")):
        (tmp_path / f"{name}.txt").write_bytes(f"{HEAD}\n{GOOD}".encode(code))
    rows = tr.trades(tr.files(spark, str(tmp_path))).collect()
    assert len(rows) == 4 and {r.note for r in rows} == {"grün"} and {r.symbol for r in rows} == {"CLG26"}


def test_preview_counts(spark):
    text = "\n".join([HEAD, GOOD, GOOD, GOOD.replace("59.28", "60"), GOOD.replace("Long\t2026", "Long\tx")])
    found = tr.trades(tr.pasted(spark, text))
    keys = ["symbol", "account", "entry_time", "entry_price"]
    known = spark.createDataFrame([("CLG26", "3Q_sim14", datetime(2026, 1, 19, 9, 30, 33), 60.0)], "symbol string, account string, entry_time timestamp, entry_price double")
    assert one(tr.preview(found, known, keys)).asDict() == {"lines": 4, "with_problems": 1, "new": 1, "duplicates": 2}
