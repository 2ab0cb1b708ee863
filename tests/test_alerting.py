import random
from datetime import datetime, timedelta

import pytest

from ledgerloom.streaming import alerting as al

T0 = datetime(2024, 1, 2, 15, 0)
RULE = al.Rule("drop", (("warning", 0.15), ("critical", 0.2), ("emergency", 0.3)), consecutive=2, cooldown_minutes=10, max_per_day=5, escalate_minutes=60)


def severities(rule, values, minutes=1):
    state, out = al.FRESH, []
    for i, x in enumerate(values):
        state, s = al.told(rule, state, int(i * minutes * 60e6), x)
        out.append(s)
    return out


def test_rules_by_hand():
    assert severities(RULE, [0.2, 0.1, 0.2, 0.2]) == [None, None, None, "critical"]  # two in a row are needed
    assert severities(RULE, [0.16] * 14) == [None, "warning"] + [None] * 9 + ["warning", None, None]  # quiet for ten minutes
    assert severities(RULE, [0.2, None, 0.31], 1)[-1] == "emergency"  # a gap tells nothing
    assert severities(RULE, [0.16] * 8, 30) == [None, "warning", "critical", "critical", "critical", "critical", None, None]  # up a tier after an hour; five a day
    low = al.Rule("rate", (("warning", 0.4), ("critical", 0.3)), high_is_bad=False, cooldown_minutes=0)
    assert severities(low, [0.5, 0.4, 0.2]) == [None, "warning", "critical"]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_stream_equals_the_finished_table(rocks, tmp_path):
    spark, r = rocks, random.Random(7)
    rows = [(r.choice("AB"), T0 + timedelta(minutes=2 * i), r.choice([0.1, 0.17, 0.22, 0.35, None])) for i in range(300)]
    schema = "account_name string, event_time timestamp, value double"
    want = []
    for a in "AB":
        state = al.FRESH
        for _, t, x in (row for row in rows if row[0] == a):
            state, s = al.told(RULE, state, int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1)), x)
            want += [(a, t, s, x, state[0])] if s else []
    shown = lambda df: sorted((x.account_name, x.event_time, x.severity, x.value, x.violations) for x in df.collect())
    assert shown(al.finished(spark.createDataFrame(rows, schema).repartition(3), RULE)) == sorted(want) and len(want) > 8
    parts = [rows[:100], rows[100:200], rows[200:], [("END", rows[-1][1] + timedelta(days=2), 0.0)]]
    parts[0][-1], parts[1][0] = parts[1][0], parts[0][-1]  # out of order by a little
    for k, part in enumerate(parts):
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = al.alerts(stream, RULE).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    assert shown(spark.read.parquet(f"{tmp_path}/out")) == sorted(want)
