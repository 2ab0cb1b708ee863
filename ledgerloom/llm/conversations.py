"""Repair of the structure of conversations by shortest paths.

A conversation is well formed if its roles are an optional system turn and then user and assistant in turn, or if it is empty. The
cheapest edits that make it so are a shortest path through a graph: a layer for every row, a node for every state of that rule, an
arc for every edit. Arc costs are small integers, so distances to the end come from a bucket queue (Dial), without a heap. The
audit, the least of the cheapest edit strings, is a walk along tight arcs that takes the least letter at every node.

A conversation may be of any length, so it is cut into blocks of turns. Distances across a block are a small matrix (cheapest cost
from each state to each), and blocks are joined by min-plus products from the last to the first. Then every block is walked by
itself, from every state it could be entered in, and a last pass streams through the blocks of a conversation, follows the states
and feeds the repaired text to a running digest. No task holds more than a block of rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: States: nothing yet, after system, after user, after assistant. By state: the state and role that an edited row would bring.
WANTED = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
#: By state: which role initials may be kept, and the state they lead to.
ALLOWED = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Costs of deleting, inserting, changing a role, and keeping a row that is cut short.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: Cost from each state to a good end, by insertions alone.
AT_END = [0, 2 * INSERT, INSERT, 0]
_FAR = 1 << 60
_INK = re.compile(r"[^\x20\x09-\x0D]")
_BLANKS = " \t\n\x0b\x0c\r"
_NO_TURN = -(1 << 62)


def distances(rows: list[tuple[str, bool, bool]], at_end: list[int]) -> list[int]:
    """Cheapest cost from every node (row * 4 + state) to the end of the rows, where ``at_end`` holds for each state.

    A row is (role initial, must go, cut short). Nodes are taken out of buckets in the order of their distance; each is settled
    once, and an arc leads at most four buckets on. Insertions at the last layer belong to what follows.
    """
    n, low = len(rows), min(at_end)
    dist = [_FAR] * (4 * n + 4)
    buckets: list[list[int]] = [[] for _ in range(max(x for x in at_end if x < _FAR) - low + 1)]
    for q, d in enumerate(at_end):
        if d < _FAR:
            dist[4 * n + q] = d - low
            buckets[d - low].append(4 * n + q)
    k = 0
    while k < len(buckets):
        bucket = buckets[k]
        while bucket:
            node = bucket.pop()
            if dist[node] != k:
                continue
            i, p = divmod(node, 4)
            arcs = []
            if i < n:
                arcs = [(4 * i + q, INSERT) for q in range(4) if WANTED[q][0] == p]
            if i:
                initial, must_go, cut = rows[i - 1]
                arcs.append((node - 4, DELETE))
                if not must_go:
                    arcs += [(4 * i - 4 + q, cut) for q in range(4) if ALLOWED[q].get(initial) == p]
                    arcs += [(4 * i - 4 + q, REROLE + cut) for q in range(4) if WANTED[q][0] == p]
            for before, cost in arcs:
                if k + cost < dist[before]:
                    dist[before] = k + cost
                    buckets += [[] for _ in range(k + cost + 1 - len(buckets))]
                    buckets[k + cost].append(before)
        k += 1
    return [d + low if d < _FAR else _FAR for d in dist]


def walk(rows: list[tuple[str, bool, bool]], dist: list[int], state: int) -> tuple[int, str]:
    """The least string of edits among the cheapest, from ``state`` before the first row, and the state after the last."""
    letters, i = [], 0
    while i < len(rows):
        here, (initial, must_go, cut), (to, _) = dist[4 * i + state], rows[i], WANTED[state]
        kept = ALLOWED[state].get(initial)
        if here == DELETE + dist[4 * i + 4 + state]:
            letters.append("D")
            i += 1
        elif here == INSERT + dist[4 * i + to]:
            letters.append("I")
            state = to
        elif not must_go and kept is not None and here == cut + dist[4 * i + 4 + kept]:
            letters.append("K")
            i, state = i + 1, kept
        else:
            letters.append("R")
            i, state = i + 1, to
    return state, "".join(letters)


def judged(rows: list[dict], seen: set[tuple[str, str]]) -> tuple[list[tuple[str, bool, bool]], list[int]]:
    """For each row its role initial, whether it must go and whether it is cut short; and the counts of blank, duplicate and
    truncated rows. ``seen`` holds the (role, text) of rows before, and gets those of these."""
    codes, counts = [], [0, 0, 0]
    for r in rows:
        role, text = r["role"], r["text"]
        blank = not _INK.search(text)
        again = (role, text) in seen
        seen.add((role, text))
        cut = not blank and text.rstrip(_BLANKS)[-1] not in ".!?"
        for k, fault in enumerate((blank, again, cut)):
            if fault:
                counts[k] += 1
                break
        codes.append((role[:1], blank or again, cut))
    return codes, counts


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that crc32(``conv_id:turn``) modulo 20 does to them; nulls are one space.

    Columns: ``conv`` (a struct, so that a null id is a key as others are), ``block``, ``turn``, ``role``, ``text`` and ``times``: 0
    for a row that is dropped (so that its conversation is still known), 2 for one that is repeated.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return conversations.select(
        F.struct(F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(filled("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def _block(turn: Column, turns: int) -> Column:
    return F.coalesce(F.floor(turn / turns), F.lit(_NO_TURN)).cast("long")


def blocks(rows: DataFrame, turns: int) -> DataFrame:
    """Blocks of ``turns`` turns with their rows by turn (nulls first; ties by role, text), and what earlier blocks hold of them.

    A row's text is in ``before`` if an earlier block of the conversation has the same role and text. Contents are met by hash,
    each conversation's by themselves, and only those that several blocks hold.
    """
    placed = rows.withColumn("block", _block(F.col("turn"), turns))
    held = placed.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "times"))).alias("rows"))
    content = placed.filter("times > 0").select("conv", "block", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("content"))
    spans = content.groupBy("conv", "content").agg(F.min("block").alias("first"), F.max("block").alias("last")).filter("first < last").select("conv", "content", "first")
    late = content.join(spans, ["conv", "content"]).filter("block > first").groupBy("conv", "block").agg(F.collect_set("content").alias("before"))
    return held.join(late, ["conv", "block"], "left")


def _expanded(rows: list[dict], before: list[str] | None) -> tuple[list[dict], set[tuple[str, str]]]:
    """Rows as often as they occur, and which of their contents earlier blocks hold."""
    known = set(before or ())
    there = {(r["role"], r["text"]) for r in rows if known and hashlib.sha256(f"{len(r['role'])}:{r['role']}{r['text']}".encode()).hexdigest() in known}
    return [r for r in rows for _ in range(r["times"])], there


def _each(make: Callable[[dict], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Row by row, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([make(r) for r in batch.to_pylist()], schema=schema)

    return run


_CONV = pa.struct([("known", pa.bool_()), ("id", pa.string())])
_CONV_SQL = "struct<known:boolean,id:string>"


def _matrix(r: dict) -> dict:
    """Cheapest cost through a block, from each state (four numbers each) to each."""
    codes, _ = judged(*_expanded(r["rows"], r["before"]))
    through = [distances(codes, [0 if p == q else _FAR for p in range(4)])[:4] for q in range(4)]
    return {"conv": r["conv"], "block": r["block"], "costs": [through[q][p] for p in range(4) for q in range(4)]}


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For blocks from the last of a conversation to its first: the cost to the end from each state after the block."""
    schema = pa.schema([("conv", _CONV), ("block", pa.int64()), ("at_end", pa.list_(pa.int64()))])
    conv, after = None, AT_END
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["conv"] != conv:
                conv, after = r["conv"], AT_END
            out.append({"conv": conv, "block": r["block"], "at_end": after})
            after = [min(r["costs"][4 * p + q] + after[q] for q in range(4)) for p in range(4)]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


_WALKED = pa.schema(
    [("conv", _CONV), ("block", pa.int64()), ("texts", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64())), ("cost", pa.int64()), ("after", pa.list_(pa.int64())), ("letters", pa.list_(pa.string()))]
)
_WALKED_SQL = f"conv {_CONV_SQL}, block long, texts array<string>, roles array<string>, counts array<long>, turns array<long>, cost long, after array<long>, letters array<string>"


def _walks(r: dict) -> dict:
    """A block's rows, counts and turns, and its walk from every state."""
    rows, seen = _expanded(r["rows"], r["before"])
    codes, counts = judged(rows, seen)
    dist = distances(codes, r["at_end"] or AT_END)
    ways = [walk(codes, dist, q) for q in range(4)]
    turns = {x["turn"] for x in rows if x["turn"] is not None}
    return {
        "conv": r["conv"], "block": r["block"], "texts": [x["text"] for x in rows], "roles": [x["role"] for x in rows], "counts": counts,
        "turns": [min(turns), max(turns), len(turns)] if turns else None, "cost": dist[0], "after": [q for q, _ in ways], "letters": [s for _, s in ways],
    }


_DONE = pa.schema([("conv", _CONV), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_DONE_SQL = f"conv {_CONV_SQL}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """What is known of a conversation while its blocks go by."""

    def __init__(self, conv: dict, cost: int) -> None:
        self.conv, self.cost, self.state = conv, cost, 0
        self.counts, self.illegal, self.last_initial = [0, 0, 0], 0, None
        self.low = self.high = None
        self.distinct = 0
        self.audit: list[str] = []
        self.digest, self.begun = hashlib.sha256(), False

    def said(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def take(self, r: dict) -> None:
        for role in r["roles"]:
            if self.last_initial is not None and self.last_initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.last_initial = role[:1]
        self.counts = [a + b for a, b in zip(self.counts, r["counts"], strict=True)]
        if r["turns"]:
            low, high, n = r["turns"]
            self.low = low if self.low is None else min(self.low, low)
            self.high = high if self.high is None else max(self.high, high)
            self.distinct += n
        letters, i = r["letters"][self.state], 0
        self.audit.append(letters)
        for x in letters:
            to, role = WANTED[self.state]
            if x == "I":
                self.said(role, "")
                self.state = to
                continue
            if x == "K":
                role = r["roles"][i]
                to = ALLOWED[self.state][role[:1]]
            if x != "D":
                self.said(role, r["texts"][i])
                self.state = to
            i += 1

    def result(self) -> dict:
        while AT_END[self.state]:
            to, role = WANTED[self.state]
            self.said(role, "")
            self.audit.append("I")
            self.state = to
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"conv": self.conv, "gaps": gaps, **dict(zip(("blank", "duplicate", "truncated"), self.counts, strict=True)), "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their blocks, which come in order."""
    now = None
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if now is None or r["conv"] != now.conv:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(r["conv"], r["cost"])
            now.take(r)
        yield pa.RecordBatch.from_pylist(out, schema=_DONE)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.result()], schema=_DONE)


def repaired(rows: DataFrame, turns: int = 128) -> DataFrame:
    """Faults and cheapest repair of every conversation of :func:`damaged` rows (or of others of that shape).

    Returns ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``. Rows
    are taken by turn, nulls first, ties by role and text; rows without a turn are one block. An empty role can't be kept. A
    conversation without rows (all with ``times`` 0) has zeros, an empty audit and the digest of nothing; so has no conversation
    of an empty table. Blocks of ``turns`` turns are the unit of memory; the result does not depend on it.
    """
    small_batches(rows.sparkSession)
    held = stored(blocks(rows, turns), "conversation-blocks")
    several = held.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv")
    long = held.join(several, "conv", "left_semi")
    costs = long.mapInArrow(_each(_matrix, pa.schema([("conv", _CONV), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])), f"conv {_CONV_SQL}, block long, costs array<long>")
    exits = costs.repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInArrow(_exits, f"conv {_CONV_SQL}, block long, at_end array<long>")
    walked = held.join(exits, ["conv", "block"], "left").mapInArrow(_each(_walks, _WALKED), _WALKED_SQL)
    return walked.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_finished, _DONE_SQL)


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The query's columns: every conversation, also those whose rows are all dropped. Columns of other names are not looked at."""
    kind = dict(conversations.dtypes)["conv_id"]
    done = repaired(damaged(conversations))
    return done.select(F.when(F.col("conv.known"), F.col("conv.id")).cast(kind).alias("conv_id"), *[c for c in done.columns if c != "conv"])
