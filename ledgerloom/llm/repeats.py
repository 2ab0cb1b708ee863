"""Exact repeated passages: maximal repeats of at least 200 bytes, by an enhanced suffix array over anchored contexts.

A suffix array of a whole corpus does not fit one task, and does not need to. Every 200-byte string picks the smallest
hash among its 40-byte substrings as its anchor, wherever it stands, so equal strings pick equal anchors at the same
offset. An anchor with the surroundings of all strings that pick it is a context (at most 360 bytes). Then

1. anchors that occur once in the corpus are dropped, by a count with map-side combining;
2. equal contexts of an anchor are one, with a multiplicity; one that occurs twice or more is a repeat group as a whole;
3. a context that occurs once meets the other contexts of its anchor in one task: a suffix array with common-prefix lengths is scanned with a stack
   into the tree of common-prefix intervals; an interval of 200 bytes or more whose suffixes differ in the byte to their
   left (or begin a context) is a maximal repeat group with all its occurrences;
4. what a context repeats is carried to all its places in the corpus.

Of an anchor with very many distinct contexts (the edge of a very common passage) the suffixes are grouped by their first
``size`` bytes: those groups are the intervals of that depth of its suffix array, so no anchor has to fit one task.

:func:`without_repeats` removes what is repeated; :func:`repeat_groups` gives the maximal repeats of the corpus with all their
occurrences, joined from the groups of neighbouring contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

GRAM = 40
_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Roller:
    """64-bit hashes of any byte range by prefix sums; powers are kept for reuse."""

    up = down = np.empty(0, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(_Roller.up) < n:
            size = max(n, 1 << 20)
            _Roller.up, _Roller.down = _powers(_BASE, size), _powers(_INVERSE, size)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: n - 1], out=self.sums[1:])

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        x = (self.sums[hi] - self.sums[lo]) * self.down[lo]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def anchors(texts: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """Of all ``size``-byte strings within single texts: (text number, anchor place, first and last string start that
    picked it, hash of the anchor, hash of the context); places count within the text."""
    width = size - GRAM + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    n = len(data)
    if n < size:
        return (np.empty(0, np.int64),) * 6
    with np.errstate(over="ignore"):
        roll = _Roller(data)
        at = np.arange(n - GRAM + 1)
        low = (roll.ranges(at, at + GRAM) & _HIGH) | at.astype(np.uint64)  # equal hashes: the leftmost
        step = 1
        while step * 2 <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < width:
            low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
        ends = np.cumsum(lengths)
        begins = ends - lengths
        starts = np.concatenate([np.arange(b, e - size + 1) for b, e in zip(begins, ends, strict=True) if e - b >= size] or [np.empty(0, np.int64)])
        if not len(starts):
            return (np.empty(0, np.int64),) * 6
        picked = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1])]))
        last = np.concatenate([new[1:], [len(starts)]]) - 1
        a, first, final = picked[new], starts[new], starts[last]
        doc = np.searchsorted(ends, first, "right")
        base = begins[doc]
        return doc, a - base, first - base, final - base, roll.ranges(a, a + GRAM).view(np.int64), roll.ranges(first, final + size).view(np.int64)


def suffix_array(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least ``least`` bytes of all texts, sorted: text, start, and the length of the prefix that each has in
    common with the next."""
    cap = max(map(len, texts), default=0)
    owner = [i for i, t in enumerate(texts) for _ in range(len(t) - least + 1)]
    start = [k for t in texts for k in range(len(t) - least + 1)]
    suffixes = [t[k : k + cap] for t in texts for k in range(len(t) - least + 1)]
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    sizes = np.fromiter((len(suffixes[i]) for i in order), np.int64, len(order))
    common = np.minimum(sizes[:-1], sizes[1:])
    step = max(1, (1 << 22) // (cap + 1))
    for lo in range(0, len(order) - 1, step):
        part = order[lo : lo + step + 1]
        rows = np.frombuffer(b"".join([suffixes[i].ljust(cap, b"\0") for i in part]), np.uint8).reshape(len(part), cap)
        unlike = rows[1:] != rows[:-1]
        first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), cap)
        common[lo : lo + len(first)] = np.minimum(common[lo : lo + len(first)], first)
    at = np.array(order, np.int64)
    return np.array(owner, np.int64)[at], np.array(start, np.int64)[at], common


def intervals(common: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal repeat groups (length, first, last place in the suffix array): nodes of the common-prefix interval tree of ``least``
    bytes or more whose suffixes do not all follow the same byte.

    ``left`` has the byte before each suffix, -1 where a text begins. The scan keeps the open intervals on a stack; each
    carries the one byte seen to the left so far, or -1 for several.
    """
    out: list[tuple[int, int, int]] = []
    deep = common >= least
    edges = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        stack: list[list[int]] = []  # length, first, left byte (-1: diverse)
        lefts, lengths = left[lo : hi + 1].tolist(), common[lo:hi].tolist()
        for i, length in enumerate([*lengths, least - 1]):
            first, seen = i, lefts[i]
            while stack and stack[-1][0] > length:
                top = stack.pop()
                seen = top[2] if top[2] == seen else -1
                if seen == -1:
                    out.append((top[0], lo + top[1], lo + i))
                first = top[1]
            if stack and stack[-1][0] == length:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else -1
            elif length >= least:
                stack.append([length, first, seen])
    return out


def maximal_repeats(texts: list[bytes], counts: list[int], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeat groups of some texts: (length, occurrences as (text, start)), all occurrences of each.

    A text that counts twice or more is laid out twice, so what it shares with its own copy is a repeat. Lengths are exact;
    memory grows with the square of the longest text (contexts have at most ``2 * least - GRAM`` bytes).
    """
    laid = [i for i, c in enumerate(counts) for _ in range(2 if c > 1 else 1)]
    owner, start, common = suffix_array([texts[i] for i in laid], least)
    left = np.fromiter((texts[laid[o]][k - 1] if k else -1 for o, k in zip(owner.tolist(), start.tolist(), strict=True)), np.int64, len(owner))
    return [(length, sorted({(laid[o], k) for o, k in zip(owner[a : b + 1].tolist(), start[a : b + 1].tolist(), strict=True)})) for length, a, b in intervals(common, left, least)]


def _covered(texts: list[bytes], counts: list[int], least: int) -> list[list[tuple[int, int]]]:
    """Per text the merged byte ranges that its maximal repeats cover."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for length, places in maximal_repeats(texts, counts, least):
        for t, at in places:
            spans[t].append((at, at + length))
    return [_merged(s) for s in spans]


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _places(docs: DataFrame, size: int) -> DataFrame:
    """Rows (h, ctx, id, th, first, final) for all anchors of all texts."""
    kind = docs.schema["id"].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "ctx", "id", "th", "first", "final"]
        for part in parts:
            texts, at, held = [], [], 0
            for i, text in enumerate(part.column("text")):
                raw = (text.as_py() or "").encode()
                if len(raw) >= size:
                    texts.append(raw)
                    at.append(i)
                    held += len(raw)
                if texts and (held >= 1 << 20 or i + 1 == part.num_rows):
                    doc, _, first, final, h, ctx = anchors(texts, size)
                    rows = pa.array(np.array(at)[doc])
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ctx), part.column("id").take(rows), part.column("th").take(rows), pa.array(first.astype(np.int32)), pa.array(final.astype(np.int32))], names)
                    texts, at, held = [], [], 0

    return docs.mapInArrow(run, f"h long, ctx long, id {kind.simpleString()}, th long, first int, final int")


def _contexts(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Bytes of the wanted contexts, cut from the texts they stand in. ``m``, how many contexts their anchor has, goes along."""
    by_text = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("h", "m", "ctx", "first", "final", "c")).alias("cuts"))
    joined = docs.join(by_text.withColumnRenamed("id", "_id").withColumnRenamed("th", "_th"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    # A text in several rows with one id gives its contexts once only.
    once = joined.groupBy("_id", "_th").agg(F.first("text").alias("text"), F.first("cuts").alias("cuts"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "m", "ctx", "width", "c", "data"]
        for part in parts:
            for text, cuts in zip(part.column("text"), part.column("cuts"), strict=True):
                raw, rows = text.as_py().encode(), cuts.as_py()
                columns = [[r[n] for r in rows] for n in ("h", "m", "ctx", "c")]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array([r["final"] - r["first"] for r in rows], pa.int32()), pa.array(columns[3], pa.int64()), pa.array([raw[r["first"] : r["final"] + size] for r in rows], pa.binary())], names)

    return once.select("text", "cuts").mapInArrow(run, "h long, m long, ctx long, width int, c long, data binary")


def _by_number(contexts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Stored contexts of anchors that have at most ``most``, and those of the others.

    A filter, not a join on the anchor: after such a join the shuffle by anchor would be left out as done already, and where the join
    is broadcast while it runs, its rows are read undealt, so that tasks hold parts of an anchor.
    """
    return contexts.filter(F.col("m") <= most).drop("m"), contexts.filter(F.col("m") > most).drop("m")


_SPANS = "h long, ctx long, width int, spans array<struct<a:int,b:int>>"


def _tree_spans(contexts: DataFrame, size: int, bytes_at_once: int = 1 << 19) -> DataFrame:
    """Covered ranges of every context, from the interval trees of its anchor's contexts.

    Contexts come sorted by anchor; a suffix array takes whole anchors until it holds ``bytes_at_once``.
    """
    span_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            covered = _covered([r[4] for r in rows], [1] * len(rows), size)
            spans = [[{"a": a, "b": b} for a, b in s] if r[3] == 1 else [] for r, s in zip(rows, covered, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array(spans, span_type)], ["h", "ctx", "width", "spans"])

        rows: list[tuple] = []
        held = 0
        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held >= bytes_at_once and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield done(rows)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, _SPANS)


def _dealt_spans(contexts: DataFrame, size: int) -> DataFrame:
    """The same for anchors with very many contexts: their strings are counted one by one, dealt out by content."""
    strings = contexts.select("h", "ctx", "width", "c", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("width")), lambda i: F.substring("data", i + 1, F.lit(size)))).alias("at", "s"))
    keyed = strings.select("h", "ctx", "width", "at", "c", F.sha2("s", 256).alias("s"))
    often = keyed.groupBy("h", "s").agg(F.sum("c").alias("n")).filter("n > 1").select("h", "s")
    return keyed.filter("c = 1").join(often, ["h", "s"]).groupBy("h", "ctx", "width").agg(F.collect_list(F.struct(F.col("at").cast("int").alias("a"), (F.col("at") + size).cast("int").alias("b"))).alias("spans"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def _shared(keyed: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Places of anchors that occur twice or more (h, ctx, id, th, first, final, width), and their contexts with a
    multiplicity ``c`` and one place."""
    places = _places(keyed, size)
    # Counted in a stage of its own: a join straight after the count could not split an anchor that very many texts hold.
    often = stored(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "often")
    shared = stored(places.join(often, "h"), "places").withColumn("width", F.col("final") - F.col("first"))
    kinds = shared.groupBy("h", "ctx", "width").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "first", "final")).alias("r"))
    return shared, stored(kinds.select("h", "ctx", "width", "c", "r.*"), "kinds")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 200, most_contexts: int = 1000) -> DataFrame:
    """``id``, ``th`` (hash of the text) and ``spans`` (byte ranges, possibly overlapping) covered by strings of ``size`` bytes that
    start at two places or more, for every text that has any."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    shared, kinds = _shared(keyed, size)
    # A context that occurs twice or more is a repeat group as a whole. Those that occur once are compared, with all others
    # of their anchor; a context alone with its anchor repeats nothing more.
    whole = kinds.filter("c > 1").select("h", "ctx", "width", F.array(F.struct(F.lit(0).alias("a"), (F.col("width") + size).alias("b"))).alias("spans"))
    mixed = stored(kinds.groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("least")).filter("m > 1 and least = 1").select("h", "m"), "mixed")
    wanted = kinds.join(mixed, "h").select("h", "m", "ctx", "c", "id", "th", "first", "final")
    contexts = stored(_contexts(wanted, keyed, size), "contexts")
    few, hot = _by_number(contexts, most_contexts)
    compared = _tree_spans(few, size).unionByName(_dealt_spans(hot, size))
    spans = stored(compared.filter(F.size("spans") > 0).unionByName(whole), "spans")
    found = shared.join(spans, ["h", "ctx", "width"]).select("id", "th", F.transform("spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b"))).alias("spans"))
    return found.groupBy("id", "th").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _tree_groups(contexts: DataFrame, size: int, bytes_at_once: int = 1 << 19) -> DataFrame:
    """Maximal repeat groups among every anchor's contexts: (h, g, length, ctx, width, at), a row per occurrence in a context."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "g", "length", "ctx", "width", "at"]

        def done(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            for length, places in maximal_repeats([r[4] for r in rows], [r[3] for r in rows], size):
                of_anchor: dict[int, list] = {}
                for t, at in places:
                    of_anchor.setdefault(rows[t][0], []).append((rows[t][1], rows[t][2], at))
                for h, found in of_anchor.items():
                    g = xxhash.xxh3_64_intdigest(repr((length, sorted(found))).encode(), 7) >> 1
                    out += [(h, g, length, *f) for f in found]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i in (0, 1, 3) else pa.int32()) for i in range(6)], names)

        rows: list[tuple] = []
        held = 0
        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held >= bytes_at_once and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield done(rows)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, g long, length int, ctx long, width int, at int")


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 200, most_contexts: int = 1000) -> DataFrame:
    """Repeat groups of the corpus: ``group``, ``length`` (bytes), the id, ``start`` (byte), a row per occurrence.

    A group is a longest string of ``size`` bytes or more that stands at all its occurrences, at equal distances: groups of
    neighbouring contexts that have the same occurrences but for one shift are one, also over a stretch that occurs still
    more often, if its bytes are equal in all of them. A string of which every ``size``-byte part occurs more often than
    itself may be given as its parts. Rows with one id are separate texts; nulls count as empty; texts under ``size`` bytes are
    in no group; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = stored(docs.select(F.col(id_col).alias("name"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "rows")
    keyed = _keyed(rows, "row", "text")
    shared, kinds = _shared(keyed, size)
    whole = kinds.filter("c > 1").select("h", F.xxhash64("ctx", "width", F.lit(1)).alias("g"), (F.col("width") + size).alias("length"), "ctx", "width", F.lit(0).alias("at"))
    mixed = stored(kinds.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "mixed")
    contexts = stored(_contexts(kinds.join(mixed, "h").select("h", "m", "ctx", "c", "id", "th", "first", "final"), keyed, size), "contexts")
    few, hot = _by_number(contexts, most_contexts)
    strings = hot.select("h", "ctx", "width", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("width")), lambda i: F.xxhash64(F.substring("data", i + 1, F.lit(size))))).alias("at", "g"))
    dealt = strings.select("h", "g", F.lit(size).alias("length"), "ctx", "width", "at")
    found = whole.unionByName(_tree_groups(few, size)).unionByName(dealt)
    places = shared.join(found, ["h", "ctx", "width"]).select(F.xxhash64("h", "g", "length").alias("g"), "length", F.col("id").alias("row"), (F.col("first") + F.col("at")).cast("long").alias("start"))
    places = stored(places.distinct(), "occurrences")
    # What a group has in common with one shifted by some bytes: its number of occurrences and their distances from the first.
    first = places.groupBy("g", "length").agg(F.min(F.struct("row", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    shape = places.join(first, ["g", "length"]).groupBy("g", "length", "first", "n").agg(F.sum(F.xxhash64("row", F.col("start") - F.col("first.start")).cast("decimal(20,0)")).alias("shape"))
    run = ["row0", "n", "shape"]
    each = stored(shape.select("g", F.col("first.row").alias("row0"), F.col("first.start").alias("a"), (F.col("first.start") + F.col("length")).alias("b"), "n", "shape"), "shapes")
    order = Window.partitionBy(*run).orderBy("a", "b", "g")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = each.withColumn("before", before).withColumn("gap", F.when(F.col("a") > F.col("before"), F.col("a") - F.col("before")))
    # Stretches between two runs of one shape: equal in all occurrences, or not.
    gaps = stored(joined.filter("gap is not null").select("g", "a", "before", "gap"), "gaps")
    stretch = places.join(gaps, "g").join(rows.select("row", F.coalesce("text", F.lit("")).cast("binary").alias("raw")), "row")
    stretch = stretch.select("g", F.xxhash64(F.substring("raw", (F.col("start") - F.col("gap") + 1).cast("int"), F.col("gap").cast("int"))).alias("bytes"), (F.col("start") >= F.col("gap")).alias("room"))
    bridged = stretch.groupBy("g").agg((F.min("bytes") == F.max("bytes")).alias("same"), F.min("room").alias("room")).filter("same and room").select("g", F.lit(True).alias("bridged"))
    parts = joined.join(bridged, "g", "left").withColumn("new", F.when(F.col("before").isNull() | (F.col("gap").isNotNull() & F.col("bridged").isNull()), 1).otherwise(0))
    parts = parts.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy(*run, "part").agg(F.min(F.struct("a", "b", "g")).alias("lead"), F.max("b").alias("to"))
    leads = merged.select(F.col("lead.g").alias("g"), (F.col("to") - F.col("lead.a")).alias("total"))
    named = places.join(leads, "g").join(rows.select("row", F.col("name").alias(id_col)), "row")
    return named.select(F.col("g").alias("group"), F.col("total").alias("length"), id_col, "start")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 200, most_contexts: int = 1000) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``removed`` (merged byte ranges) and ``kept`` (the remaining bytes).

    Every byte covered by a ``size``-byte string that also starts anywhere else is removed, judged on the input. Null texts
    count as empty; texts under ``size`` bytes lose nothing; repeated rows repeat each other, so they lose all bytes.
    """
    spans = repeated_spans(docs, id_col, text_col, size=size, most_contexts=most_contexts).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "spans")
    keyed = _keyed(docs, id_col, text_col)
    joined = keyed.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("id", "text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    range_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 256):
                cut, sizes, removed, kept = part.slice(lo, 256), [], [], []
                for text, found in zip(cut.column("text"), cut.column("spans"), strict=True):
                    raw = text.as_py().encode()
                    out = _merged((s["a"], s["b"]) for s in found.as_py() or ())
                    edges = [0, *(x for s in out for x in s), len(raw)]
                    sizes.append(len(raw))
                    removed.append([{"a": a, "b": b} for a, b in out])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([cut.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, range_type), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(run, f"id {kind}, n_bytes long, removed array<struct<a:long,b:long>>, kept binary").withColumnRenamed("id", id_col)


def repeats_digest(docs: DataFrame) -> DataFrame:
    """The query's columns, from :func:`without_repeats`."""
    done = without_repeats(docs)
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return done.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
