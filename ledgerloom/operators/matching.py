"""Other ways from fills to trades: by parent order, by order id, split fills, completeness, orphaned closes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fills import BOOK


def by_parent(fills: DataFrame, commission: float = 4.2) -> DataFrame:
    """Opening fills meet closing ones of the same account, symbol and parent order; profit is net of commission.

    Of several openings or closings of an order, lots and volume-weighted prices count. Orders without both sides give nothing.
    """
    side = lambda kind: F.when(F.col("open_close") == kind, F.col("quantity"))
    vwap = lambda q: F.sum(q * F.col("price")) / F.sum(q)
    opened, closed = side("OPEN"), side("CLOSE")
    g = fills.groupBy("account", "symbol", "parent_id").agg(F.sum(opened).alias("opened"), F.sum(closed).alias("closed"), vwap(opened).alias("entry_price"), vwap(closed).alias("exit_price"), F.min(F.when(F.col("open_close") == "OPEN", F.struct("ts", "fill_id", "side"))).alias("first"), F.max(F.when(F.col("open_close") == "CLOSE", F.col("ts"))).alias("exit_time"))
    lots = F.least("opened", "closed")
    sign = F.when(F.col("first.side") == "BUY", 1).otherwise(-1)
    gross = (F.col("exit_price") - F.col("entry_price")) * lots * sign
    return g.filter("opened > 0 and closed > 0").select("account", "symbol", "parent_id", F.when(sign == 1, "LONG").otherwise("SHORT").alias("direction"), lots.cast("long").alias("quantity"), F.col("first.ts").alias("entry_time"), "exit_time", "entry_price", "exit_price", (gross - commission * lots).alias("net"))


def unmatched(fills: DataFrame, matched: DataFrame) -> DataFrame:
    """Fills of orders without a match, which first-in-first-out can pair."""
    return fills.join(matched.select("account", "symbol", "parent_id"), ["account", "symbol", "parent_id"], "left_anti")


def by_order(fills: DataFrame, commission: float = 2.5) -> DataFrame:
    """Orders by account, symbol and calendar date: where bought and sold lots agree, the profit net of commission, else null."""
    q = lambda s: F.when(F.col("side") == s, F.col("quantity"))
    vwap = lambda s: F.sum(q(s) * F.col("price")) / F.sum(q(s))
    g = fills.groupBy("account", "symbol", F.to_date("ts").alias("date"), "parent_id").agg(F.coalesce(F.sum(q("BUY")), F.lit(0)).alias("bought"), F.coalesce(F.sum(q("SELL")), F.lit(0)).alias("sold"), vwap("BUY").alias("b"), vwap("SELL").alias("s"))
    return g.select("account", "symbol", "date", "parent_id", "bought", "sold", (F.col("bought") == F.col("sold")).alias("matched"), F.when(F.col("bought") == F.col("sold"), (F.col("s") - F.col("b") - commission) * F.col("bought")).alias("net"))


def split_fills(trips: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Trips that are equal but for lots and money become one with their sums."""
    return trips.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("parts"))


def complete(fills: DataFrame) -> DataFrame:
    """Fills of books (account, symbol, session) that end flat."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    flat = fills.groupBy(*BOOK).agg(F.sum(signed).alias("position")).filter("position = 0").select(*BOOK)
    return fills.join(flat, BOOK, "left_semi")


#: Arrow types of what hours are reduced to.
_TYPES = {"total": pa.field("total", pa.int64()), "from": pa.field("from", pa.list_(pa.int64())), "to": pa.field("to", pa.list_(pa.int64())), "fill_id": pa.field("fill_id", pa.int64())}


def _shift(steps: list[tuple[int, bool]]) -> tuple[int, dict[int, int]]:
    """What a block of fills does to a position: it adds the total, but for the positions listed, which meet a close while flat.

    A step is (signed lots, whether it closes). A close at a flat position is left out, so from there on the walk goes on at zero.
    From the last step back: where the walk from zero at a step ends is known from the next close that it meets while flat.
    """
    before, total = [], 0
    for q, _ in steps:
        before.append(total)
        total += q
    flat_at: dict[int, int] = {}  # by sum before it: the first close from here on
    ends = [0] * (len(steps) + 1)  # where a walk that is at zero before the step ends
    for i in range(len(steps) - 1, -1, -1):
        if steps[i][1]:
            flat_at[before[i]] = i
        j = flat_at.get(before[i])
        ends[i] = total - before[i] if j is None else ends[j + 1]
    return total, {-p: ends[i + 1] for p, i in flat_at.items()}


def orphaned_closes(fills: DataFrame, ghosts: DataFrame) -> DataFrame:
    """Closing fills that meet a flat position in a book that lost ghosts: their openings were ghosts, so they go too.

    Whether a position is flat depends on which closes went before. A book is cut into hours; what an hour does to a position is a
    shift with exceptions (:func:`_shift`), which can be applied without its fills, so hours are summarised side by side, positions
    at their beginnings folded from the summaries, and each hour walked from there. Columns fill_id, ts, side, quantity,
    open_close; returns fill_id.
    """
    books = ghosts.select(*BOOK).distinct()
    held = fills.join(books, BOOK, "left_semi").select(*BOOK, F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "fill_id", "ts", "side", "quantity", "open_close")
    keys = [*BOOK, "hour"]
    kinds = dict(held.dtypes)
    named = ", ".join(f"{c} {kinds[c]}" for c in keys)
    step = lambda r: (r["quantity"] if r["side"] == "BUY" else -r["quantity"], (r["open_close"] or "").upper() == "CLOSE")

    def each_hour(make: Callable[[dict, list[dict]], list[dict]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """``make`` of every hour's rows, which come sorted, so that one hour is held at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind, key, rows = None, None, []
            for batch in batches:
                kind = kind or pa.schema([_TYPES[n] if n in _TYPES else batch.schema.field(n) for n in names])
                out = []
                for r in batch.to_pylist():
                    k = tuple(r[c] for c in keys)
                    if rows and k != key:
                        out += make(dict(zip(keys, key, strict=True)), rows)
                        rows = []
                    key = k
                    rows.append(r)
                yield pa.RecordBatch.from_pylist(out, schema=kind)
            if rows:
                yield pa.RecordBatch.from_pylist(make(dict(zip(keys, key, strict=True)), rows), schema=kind)

        return run

    def summed(key: dict, rows: list[dict]) -> list[dict]:
        total, odd = _shift([step(r) for r in rows])
        return [key | {"total": total, "from": list(odd), "to": list(odd.values())}]

    def walked(key: dict, rows: list[dict]) -> list[dict]:
        # The row without a fill comes first and has the position before the hour.
        position, gone = rows[0]["start"], []
        for r in rows[1:]:
            q, closes = step(r)
            if position == 0 and closes:
                gone.append({"fill_id": r["fill_id"]})
            else:
                position += q
        return gone

    dealt = held.repartition(*keys).sortWithinPartitions(*keys, "ts", "fill_id")
    hours = dealt.mapInArrow(each_hour(summed, [*keys, "total", "from", "to"]), f"{named}, total long, `from` array<long>, `to` array<long>")
    before = Window.partitionBy(*BOOK).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    shifts = F.collect_list(F.struct("total", F.map_from_arrays("from", "to").alias("odd"))).over(before)
    starts = hours.select(*keys, F.aggregate(shifts, F.lit(0).cast("long"), lambda p, x: F.coalesce(F.try_element_at(x["odd"], p), p + x["total"])).alias("start"))
    # Starts come as rows of their own. After a join on the same keys the shuffle by hours would be left out as done already, and a
    # join that is broadcast while it runs then reads its fills undealt, so that tasks hold parts of hours.
    known = held.withColumn("start", F.lit(None).cast("long")).unionByName(starts, allowMissingColumns=True)
    known = known.withColumn("_fill", F.when(F.col("start").isNull(), 1).otherwise(0)).repartition(*keys).sortWithinPartitions(*keys, "_fill", "ts", "fill_id")
    return known.mapInArrow(each_hour(walked, ["fill_id"]), "fill_id long")
