"""Pairing in a stream of small batches against the finished table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import timeplane as tp
from ledgerloom.operators import fills as fl
from ledgerloom.plans import views as v
from ledgerloom.streaming import pairing

SF = "/root/testdata/sf0.001"
COLUMNS = ["account", "symbol", "session", "direction", "quantity", "entry_time", "exit_time", "entry_price", "exit_price", "points"]


def test_legs_by_hand():
    fill = lambda i, side, n, price: (i, i, side, n, price)
    legs, closed = pairing.paired([], fill(1, "BUY", 3, 10.0))
    legs, closed = pairing.paired(legs, fill(2, "BUY", 2, 11.0))
    legs, closed = pairing.paired(legs, fill(3, "SELL", 7, 12.0))
    assert [(leg[1], lots) for leg, lots in closed] == [(1, 3), (2, 2)]
    assert legs == [(3, 3, "SELL", 2, 12.0)]  # turned over


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_stream_equals_the_finished_table(rocks, tmp_path):
    spark = rocks
    fills = v.fills(spark, SF).withColumn("session", tp.session_date(tp.new_york(F.col("ts")))).withColumn("ts", F.col("ts").cast("timestamp"))
    columns = ["account", "symbol", "session", "ts", "fill_id", "side", "quantity", "price"]
    rows = sorted(fills.select(*columns).collect(), key=lambda r: r.ts)
    # Five batches; fills near an edge come in the batch before or after, within the lateness.
    r = random.Random(6)
    parts = [[] for _ in range(5)]
    edges = [rows[len(rows) * k // 5].ts for k in range(1, 5)]
    for x in rows:
        k = sum(x.ts >= e for e in edges)
        if k and x.ts - edges[k - 1] < timedelta(hours=2) and r.random() < 0.5:
            k -= 1
        parts[k].append(x)
    # A fill long after all others lets the watermark pass them, twice so that it is known before the last batch.
    late = rows[-1].ts + timedelta(days=9)
    parts.append([rows[-1].asDict() | {"account": "END", "fill_id": 10**9, "ts": late, "session": late.date() + timedelta(days=1)}])
    for k, part in enumerate(parts):
        r.shuffle(part)
        spark.createDataFrame([tuple(x[c] for c in columns) for x in part], fills.select(*columns).schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(fills.select(*columns).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = pairing.round_trips(stream, late="3 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    out.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    shown = lambda df: sorted(str([r[c] for c in COLUMNS]) for r in df.collect())
    assert shown(got.filter("kind = 'trade'")) == shown(fl.fifo(fills.select(*columns)).withColumns({c: F.col(c).cast("timestamp") for c in ("entry_time", "exit_time")}))
    sign = F.when(F.col("direction") == "LONG", 1).otherwise(-1)
    left = {(r.account, r.symbol, r.session): r.q for r in got.filter("kind = 'open'").groupBy("account", "symbol", "session").agg(F.sum(sign * F.col("quantity")).alias("q")).collect()}
    assert left == {(r.account, r.symbol, r.session): r.position for r in fl.open_positions(fills).collect()}


def test_sessions_end_at_five_in_new_york():
    assert pairing.session_end(datetime(2024, 7, 5).date()) - pairing.session_end(datetime(2024, 1, 5).date()) == 182 * 86_400_000 - 3_600_000
