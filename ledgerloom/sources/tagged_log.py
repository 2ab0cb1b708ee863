"""Binary activity logs of tagged values, as a data source that reads byte ranges, and their fills.

A file is a sequence of (tag, length, value), both numbers 32-bit little-endian. A value of the time tag begins a record; what
follows up to the next belongs to it. The source plans ranges of bytes, so a large file is read by many tasks: a range owns the
records that begin in it, finds the first by looking for a time tag that further valid tags follow, and reads beyond its end
until its last record is whole. A stretch that can't be read is skipped up to the next time tag and counted.

What the records mean (times, prices, sides, fills) is decided by DataFrame functions in :func:`fills`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tags of the format, by the column they fill. Fixed values.
TEXTS = {103: "symbol", 107: "order_type", 100: "order_id", 124: "order_id", 130: "note", 137: "service_id", 139: "link"}
CODES = {109: "side_code", 112: "status_code", 120: "open_close_code"}
DOUBLES = {108: "quantity", 113: "fill_price", 114: "filled_quantity", 125: "position_after"}
LONGS = {105: "internal_id"}
TIME, MESSAGE = 102, 104
#: Tags and lengths above these are no tags.
MOST_TAG, MOST_LENGTH = 512, 65_536

SCHEMA = (
    "file string, start long, time_double double, time_long long, symbol string, order_type string, order_id string, note string, service_id string, link string, "
    "side_code int, status_code int, open_close_code int, quantity double, fill_price double, filled_quantity double, position_after double, internal_id long, messages array<string>, problem string"
)
_TEXT_COLUMNS = list(dict.fromkeys(TEXTS.values()))
_ARROW = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("time_double", pa.float64()), ("time_long", pa.int64())]
    + [(c, pa.string()) for c in _TEXT_COLUMNS]
    + [(c, pa.int32()) for c in CODES.values()]
    + [(c, pa.float64()) for c in DOUBLES.values()]
    + [(c, pa.int64()) for c in LONGS.values()]
    + [("messages", pa.list_(pa.string())), ("problem", pa.string())]
)


class Range(InputPartition):
    def __init__(self, file: str, lo: int, hi: int, size: int) -> None:
        self.file, self.lo, self.hi, self.size = file, lo, hi, size


def _header(data: bytes, at: int) -> tuple[int, int] | None:
    """Tag and length at a place, if they can be such."""
    if at + 8 > len(data):
        return None
    tag, length = struct.unpack_from("<II", data, at)
    return (tag, length) if 0 < tag <= MOST_TAG and length <= MOST_LENGTH else None


def synced(data: bytes, at: int, ends: bool, steps: int = 4) -> int:
    """The first place from ``at`` on where a time tag stands that ``steps`` valid tags (or the file's end) follow; -1 if none."""
    mark = struct.pack("<II", TIME, 8)
    while (at := data.find(mark, at)) >= 0:
        place = at
        for _ in range(steps):
            head = _header(data, place)
            if head is None:
                break
            place += 8 + head[1]
        else:
            return at
        if ends and place >= len(data) - 7:
            return at
        at += 1
    return -1


def records(data: bytes, base: int, lo: int, hi: int, ends: bool) -> Iterator[dict]:
    """The records of ``data`` (which stands at ``base`` of its file) that begin in [lo, hi). ``ends``: the file ends with the data."""
    at = lo - base
    if lo:
        at = synced(data, at, ends)
        if at < 0:
            return
    now: dict | None = None
    while at < len(data):
        head = _header(data, at)
        if head is None:
            if at + 8 > len(data):
                if now is not None and ends:
                    now["problem"] = "cut off"
                break
            after = synced(data, at + 1, ends)
            if now is None and base + at < hi:
                now = {"start": base + at, "messages": []}
            if now is not None:
                now["problem"] = f"skipped {(after if after >= 0 else len(data)) - at} bytes"
            if after < 0:
                break
            at = after
            continue
        tag, length = head
        if at + 8 + length > len(data):
            if now is not None and ends:
                now["problem"] = "cut off"
            break
        value = data[at + 8 : at + 8 + length]
        if tag == TIME:
            if now is not None:
                yield now
            now = None
            if base + at >= hi:
                return
            now = {"start": base + at, "messages": []}
            if length >= 8:
                now["time_double"], now["time_long"] = struct.unpack_from("<d", value)[0], struct.unpack_from("<q", value)[0]
        else:
            if now is None:
                now = {"start": base + at, "messages": []}  # values before the first time of a file
            if tag == MESSAGE:
                now["messages"].append(value.decode("utf-8", "ignore"))
            elif tag in TEXTS:
                text = value.decode("utf-8", "ignore").strip("\x00 \t\r\n")
                if text:
                    name = TEXTS[tag]
                    now[name] = f"{now[name]} {text}" if name == "note" and name in now else text
            elif tag in CODES and length:
                now[CODES[tag]] = value[0]
            elif tag in DOUBLES and length == 8:
                now[DOUBLES[tag]] = struct.unpack("<d", value)[0]
            elif tag in LONGS and length == 8:
                now[LONGS[tag]] = struct.unpack("<q", value)[0]
        at += 8 + length
    if now is not None:
        yield now


class TaggedLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("splitbytes", options.get("splitBytes", 32 << 20)))

    def _files(self) -> list[fs.FileInfo]:
        system, path = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            return sorted((f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(".data")), key=lambda f: f.path)
        return [info]

    def partitions(self) -> list[Range]:
        return [Range(f.path, lo, min(lo + self.split, f.size), f.size) for f in self._files() for lo in range(0, f.size, self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with system.open_input_file(part.file) as f:
            data, more = f.read_at(part.hi - part.lo, part.lo), part.hi
            while more < part.size and not self._whole(data, part.hi - part.lo):
                data += f.read_at(min(1 << 20, part.size - more), more)
                more = part.lo + len(data)
        held: list[dict] = []
        for r in records(data, part.lo, part.lo, part.hi, more >= part.size):
            held.append(r | {"file": part.file})
            if len(held) >= 5000:
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    @staticmethod
    def _whole(data: bytes, upto: int) -> bool:
        """Whether a record begins after the range and enough follows to be sure of it."""
        return synced(data, upto, False) >= 0


class TaggedLog(DataSource):
    """``spark.read.format("tagged_log").load(path)``: a file or a folder of ``.data`` files; option ``splitBytes``. Paths may have any
    scheme that pyarrow knows."""

    @classmethod
    def name(cls) -> str:
        return "tagged_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TaggedLogReader:
        return TaggedLogReader(self.options)


def read(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """The records of a log or of a folder of logs."""
    spark.dataSource.register(TaggedLog)
    return spark.read.format("tagged_log").option("splitBytes", str(split_bytes)).load(path)


def time_of(as_double: Column, as_long: Column) -> Column:
    """The time a record's eight bytes stand for, told by the range they lie in: days since 1899-12-30 as a double (clock time of the
    writer), microseconds since 1970 or since 1899-12-30, milliseconds since 1970. Null for others."""
    days_us = F.lit(25_569 * 86_400_000_000)  # from 1899-12-30 to 1970
    us = (
        F.when((as_double > 30_000) & (as_double < 70_000), F.round(as_double * 86_400_000_000).cast("long") - days_us)
        .when(as_long.between(1_262_304_000_000_000, 2_082_758_400_000_000), as_long)
        .when(as_long.between(3_400_000_000_000_000, 4_500_000_000_000_000), as_long - days_us)
        .when(as_long.between(1_262_304_000_000, 2_082_758_400_000), as_long * 1000)
    )
    at = F.timestamp_micros(us)
    return F.when(F.year(at).between(2010, 2035), at)


def _number(text: Column, pattern: str) -> Column:
    return F.rtrim(F.regexp_extract(text, pattern, 1), F.lit(".")).try_cast("double")


def fills(logs: DataFrame) -> DataFrame:
    """The fills that records tell of: file, account, symbol, ts, side, price, quantity, order_id, note, messages, open_close,
    position_after, position_order.

    Records of one file and time are one event. It is a fill if a message says so and does not restate a position. Its price is
    the fill price tag, else the ask (bought) or bid (sold), else the price named; its quantity the largest that is told; its side
    follows the change of position, the side code, or the words. Dropped are events without a side, with a status other than 8,
    of stop and limit orders without an evaluator's message and a fill price, and of orders that are cancelled later on.
    ``position_order`` is the place of the order among the file's position updates, 999999 if it has none. Symbols carry on
    within a file; the account is the part of the file's name before its ending.
    """
    infile = Window.partitionBy("file").orderBy("start")
    ts = time_of(F.col("time_double"), F.col("time_long"))
    rows = logs.withColumn("ts", F.last(ts, ignorenulls=True).over(infile)).withColumn("symbol", F.last("symbol", ignorenulls=True).over(infile))
    said = F.lower(F.array_join("messages", "\n"))
    update = r"updated internal position quantity to\s*(-?\d+)\.\s*previous:\s*(-?\d+)\.\s*fill of internalorderid:\s*([0-9]+)"
    rows = rows.withColumn("said", said).withColumn("moved", F.regexp_extract("said", update, 1).try_cast("int") - F.regexp_extract("said", update, 2).try_cast("int"))
    rows = rows.withColumn("moved_id", F.nullif(F.regexp_extract("said", r"updated internal position[\s\S]*?fill of internalorderid:\s*([0-9]+)", 1), F.lit("")))
    restates = F.col("said").rlike("updated (internal|service) position|updated position quantity|synchronized (internal|service) position|internal ?order ?id")
    rows = rows.withColumn("filled", F.col("said").rlike(r"trade simulation fill|fill: |\(filled\)") & ~restates)
    words = F.when(F.col("said").rlike("buy|bought|long"), "BUY").when(F.col("said").rlike("sell|sold|short"), "SELL")
    coded = F.regexp_extract("said", r"buy\s*sell\s*:\s*(\d)", 1)
    rows = rows.withColumn("worded", F.when(coded == "1", "BUY").when(coded != "", "SELL").otherwise(words))
    asked = {n: F.when(F.col("filled"), _number(F.col("said"), rf"{p}[:\s]*(\d+\.?\d*)")) for n, p in (("bid", "bid"), ("ask", "ask"), ("last", "last"), ("named", "(?:fillprice|price)"))}
    rows = rows.withColumns(asked).withColumn("told", F.when(F.col("filled"), F.regexp_extract("said", r"(?:qty|quantity|size|q:|vol)\s*:?\s*(\d+)", 1).try_cast("int")))
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("start")))
    between = lambda c, hi: F.max(F.when((F.col(c) > 0) & (F.col(c) < hi), F.col(c)))
    event = rows.filter("ts is not null").groupBy("file", "ts").agg(
        F.bool_or("filled").alias("filled"),
        F.min("start").alias("start"),
        newest("symbol").alias("symbol"),
        F.coalesce(newest("moved_id"), newest("order_id")).alias("order_id"),
        newest("internal_id").cast("string").alias("internal_id"),
        F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("start", "note")))), lambda x: x["note"]), " "), F.lit("")).alias("note"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "messages"))), lambda x: F.array_join(x["messages"], " ")), " ").alias("message"),
        newest("order_type").alias("order_type"),
        newest("status_code").alias("status"),
        newest("open_close_code").alias("open_close_code"),
        newest("position_after").cast("int").alias("position_after"),
        F.coalesce(F.when(newest("moved") > 0, "BUY").when(newest("moved") < 0, "SELL"), F.when(newest("side_code") == 1, "BUY").when(newest("side_code") == 2, "SELL"), newest("worded")).alias("side"),
        F.greatest(F.lit(1), F.max("told"), F.max(F.abs("moved")), between("filled_quantity", 500).cast("int"), between("quantity", 500).cast("int")).alias("quantity"),
        newest("bid").alias("bid"), newest("ask").alias("ask"), newest("last").alias("last"), newest("named").alias("named"),
        F.max_by(F.col("fill_price"), F.when((F.col("fill_price") > 0) & (F.col("fill_price") < 500_000), F.col("start"))).alias("fill_price"),
    ).filter("filled")
    quoted = F.when(F.col("side") == "BUY", F.col("ask")).when(F.col("side") == "SELL", F.col("bid"))
    event = event.withColumn("price", F.coalesce("fill_price", quoted, "named", "last", "ask", "bid"))
    resting = F.lower(F.coalesce("order_type", F.lit(""))).rlike("stop|limit")
    real = F.col("side").isNotNull() & F.col("price").isNotNull() & (F.coalesce("status", F.lit(8)) == 8) & (~resting | (F.lower("message").contains("trading evaluator") & F.col("fill_price").isNotNull()))
    cancelled = rows.filter(F.col("said").rlike("marking as canceled|order update from server|internally marking") & F.col("order_id").isNotNull()).select("file", F.col("order_id").alias("gone")).distinct()
    kept = event.filter(real).join(cancelled, (event["file"] == cancelled["file"]) & (F.col("order_id") == F.col("gone")), "left_anti")
    place = F.row_number().over(infile) - 1
    order = rows.filter("moved_id is not null").select("file", "moved_id", place.alias("place")).groupBy("file", "moved_id").agg(F.max("place").alias("place"))
    order = order.select(F.col("file").alias("of"), "moved_id", "place")
    key = F.coalesce("internal_id", "order_id")
    base = F.element_at(F.split("file", "/"), -1)
    parts = F.split(base, r"\.")
    account = F.regexp_replace(F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(base), "(?i)_UTC$", "")
    return kept.join(order, (F.col("file") == F.col("of")) & (key == F.col("moved_id")), "left").select(
        "file", account.alias("account"), "symbol", "ts", "side", "price", "quantity", "order_id", "note", F.col("message").alias("messages"),
        F.when(F.col("open_close_code") == 1, "OPEN").when(F.col("open_close_code") == 2, "CLOSE").otherwise("").alias("open_close"), "position_after", F.coalesce("place", F.lit(999_999)).alias("position_order"),
    )
