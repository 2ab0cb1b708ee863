"""Alert rules with memory: severity tiers, consecutive violations, cooldown, a daily maximum, and escalation, per key.

The rule is one small function of a state of five numbers and a measure; a stream and a finished table run the same one. Needs the
RocksDB state store (``spark.sql.streaming.stateStore.providerClass``) for streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_DAY = 86_400_000_000


@dataclass(frozen=True)
class Rule:
    """``tiers``: (severity, threshold) from the mildest on; a measure at or beyond a threshold (above, or below if not
    ``high_is_bad``) violates it. ``escalate_minutes``: a violation that lasts as long is told one tier up."""

    name: str
    tiers: tuple[tuple[str, float], ...]
    consecutive: int = 1
    cooldown_minutes: float = 30.0
    max_per_day: int = 10
    escalate_minutes: float | None = None
    high_is_bad: bool = True


#: violations in a row, when they began, until when it is quiet, the day (UTC) and its number of alerts.
FRESH = (0, 0, 0, -1, 0)


def told(rule: Rule, state: tuple[int, int, int, int, int], us: int, value: float | None) -> tuple[tuple[int, int, int, int, int], str | None]:
    """The state after a measure at a time (microseconds), and the severity of the alert if there is one. A null measure tells nothing."""
    run, since, quiet, day, count = state
    if value is None:
        return state, None
    tier = sum((value >= t) if rule.high_is_bad else (value <= t) for _, t in rule.tiers) - 1
    if tier < 0:
        return (0, 0, quiet, day, count), None
    since = since if run else us
    run += 1
    if us // _DAY != day:
        day, count = us // _DAY, 0
    if run < rule.consecutive or us < quiet or count >= rule.max_per_day:
        return (run, since, quiet, day, count), None
    if rule.escalate_minutes is not None and us - since >= rule.escalate_minutes * 60e6:
        tier = min(tier + 1, len(rule.tiers) - 1)
    return (run, since, us + int(rule.cooldown_minutes * 60e6), day, count + 1), rule.tiers[tier][0]


OUT = T.StructType([T.StructField(n, t) for n, t in (("account_name", T.StringType()), ("event_time", T.TimestampType()), ("rule", T.StringType()), ("severity", T.StringType()), ("value", T.DoubleType()), ("violations", T.IntegerType()))])


def finished(measures: DataFrame, rule: Rule) -> DataFrame:
    """Alerts of a finished table of measures (account_name, event_time, value), taken by time, ties by value. A task walks the
    measures of one account, batch by batch of a sorted stream, so it holds no account whole."""
    kind = pa.schema([("account_name", pa.string()), ("event_time", pa.timestamp("us", "UTC")), ("rule", pa.string()), ("severity", pa.string()), ("value", pa.float64()), ("violations", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, state, begun = None, FRESH, False
        for batch in batches:
            out = []
            for a, us, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != account or not begun:
                    account, state, begun = a, FRESH, True
                state, severity = told(rule, state, us, x)
                if severity:
                    out.append({"account_name": a, "event_time": us, "rule": rule.name, "severity": severity, "value": x, "violations": state[0]})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    rows = measures.select("account_name", F.unix_micros(F.col("event_time").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value"))
    return rows.repartition("account_name").sortWithinPartitions("account_name", "us", "value").mapInArrow(run, OUT)


class Alerting(StatefulProcessor):
    """Measures wait until the watermark has passed them, then go through the rule in the order of their times."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("us", T.LongType()), T.StructField("value", T.DoubleType())]))
        self.state = handle.getValueState("state", T.StructType([T.StructField(f"s{i}", T.LongType()) for i in range(5)]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = lambda t: int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() * 1_000_000)
        self.waiting.appendList([(at(r.event_time), r.value) for r in rows])
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, watermark: int) -> Iterator[Row]:
        known = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
        due = [r for r in known if r[0] <= watermark * 1000]
        rest, out = known[len(due) :], []
        state = tuple(self.state.get()) if self.state.exists() else FRESH
        for us, x in due:
            state, severity = told(self.rule, state, us, x)
            if severity:
                out.append(Row(account_name=key[0], event_time=datetime(1970, 1, 1) + timedelta(microseconds=us), rule=self.rule.name, severity=severity, value=x, violations=state[0]))
        self.state.update(state)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(rest[0][0] // 1000 + 1, watermark + 1))
        else:
            self.waiting.clear()
        return iter(out)

    def close(self) -> None:
        pass


def alerts(measures: DataFrame, rule: Rule, late: str = "10 minutes") -> DataFrame:
    """Alerts of a stream of measures (account_name, event_time, value), the same as :func:`finished` gives on the whole. Measures may
    come up to ``late`` out of order; later ones are dropped by the watermark."""
    timed = measures.select("account_name", F.col("event_time").cast("timestamp").alias("event_time"), F.col("value").cast("double").alias("value")).withWatermark("event_time", late)
    return timed.groupBy("account_name").transformWithState(statefulProcessor=Alerting(rule), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
