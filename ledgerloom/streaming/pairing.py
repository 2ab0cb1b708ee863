"""First-in-first-out pairing of fills in a stream, with the open legs of every book as state.

The batch form is :func:`ledgerloom.operators.fills.fifo`; a stream of the same fills, in whatever micro-batches, gives the same
trades. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.fills import BOOK

NEW_YORK = ZoneInfo("America/New_York")
OUT = T.StructType(
    [
        T.StructField("account", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("session", T.DateType()),
        T.StructField("kind", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("entry_time", T.TimestampType()),
        T.StructField("exit_time", T.TimestampType()),
        T.StructField("entry_price", T.DoubleType()),
        T.StructField("exit_price", T.DoubleType()),
        T.StructField("points", T.DoubleType()),
    ]
)
_WAITING = T.StructType([T.StructField("us", T.LongType()), T.StructField("fill_id", T.LongType()), T.StructField("side", T.StringType()), T.StructField("quantity", T.LongType()), T.StructField("price", T.DoubleType())])


def session_end(session: date) -> int:
    """When a session ends, 17:00 in New York, in milliseconds."""
    return int(datetime(session.year, session.month, session.day, 17, tzinfo=NEW_YORK).timestamp() * 1000)


def paired(legs: list[tuple], fill: tuple) -> tuple[list[tuple], list[tuple]]:
    """The open legs after a fill, and what it closes: (leg, lots). Legs and fills are (us, fill_id, side, quantity, price)."""
    us, i, side, left, price = fill
    closed = []
    while left and legs and legs[0][2] != side:
        leg = legs[0]
        lots = min(left, leg[3])
        closed.append((leg, lots))
        left -= lots
        legs = legs[1:] if lots == leg[3] else [(*leg[:3], leg[3] - lots, leg[4]), *legs[1:]]
    return (legs + [(us, i, side, left, price)] if left else legs), closed


class Pairing(StatefulProcessor):
    """A book's fills wait until the watermark has passed them, so they are paired in the order of their times (and ids), not of
    their arrival. At the end of the session open legs are given out as such, and the book's state goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.legs = handle.getListState("legs", _WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.waiting.appendList([(int(r.event_time.replace(tzinfo=UTC).timestamp() * 1_000_000) if r.event_time.tzinfo is None else int(r.event_time.timestamp() * 1_000_000), r.fill_id, r.side, r.quantity, r.price) for r in rows])
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, watermark: int) -> Iterator[Row]:
        account, symbol, session = key
        known = sorted(tuple(r) for r in self.waiting.get())
        due = [f for f in known if f[0] <= watermark * 1000]
        rest = known[len(due) :]
        legs, out = [tuple(r) for r in self.legs.get()], []
        at = lambda us: datetime(1970, 1, 1) + timedelta(microseconds=us)
        for fill in due:
            legs, closed = paired(legs, fill)
            for leg, lots in closed:
                long = leg[2] == "BUY"
                points = (fill[4] - leg[4]) * lots * (1 if long else -1)
                out.append(Row(account=account, symbol=symbol, session=session, kind="trade", direction="LONG" if long else "SHORT", quantity=lots, entry_time=at(leg[0]), exit_time=at(fill[0]), entry_price=leg[4], exit_price=fill[4], points=points))
        end = session_end(session)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if watermark >= end and not rest:
            out += [Row(account=account, symbol=symbol, session=session, kind="open", direction="LONG" if leg[2] == "BUY" else "SHORT", quantity=leg[3], entry_time=at(leg[0]), exit_time=None, entry_price=leg[4], exit_price=None, points=None) for leg in legs]
            self.waiting.clear()
            self.legs.clear()
            return iter(out)
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.legs.put(legs) if legs else self.legs.clear()
        self.handle.registerTimer(max(min([end, *[f[0] // 1000 + 1 for f in rest[:1]]]), watermark + 1))
        return iter(out)

    def close(self) -> None:
        pass


def round_trips(fills: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Trades of a stream of fills (account, symbol, session, ts, fill_id, side, quantity, price) as they close, and open legs at the
    end of each session (``kind`` is trade or open).

    Fills may come up to ``late`` out of order; later ones are dropped by the watermark, and the query's progress counts them.
    A fill waits for as long, so a trade is given out once no fill can come before it. A book's state is its waiting fills and
    open legs of one session.
    """
    timed = fills.withColumn("event_time", fills["ts"].cast("timestamp")).withWatermark("event_time", late)
    timed = timed.select(*BOOK, "event_time", "fill_id", "side", timed["quantity"].cast("long").alias("quantity"), "price")
    return timed.groupBy(*BOOK).transformWithState(statefulProcessor=Pairing(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
