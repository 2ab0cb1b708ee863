"""How filters of a corpus act on each other: survivors of every subset, and of every order, from one count.

A document's failures are one mask of bits. Counts of masks by part, a handful of numbers however many documents there are, hold
all that can be asked: a subset-zeta transform turns them into the survivors of every subset of filters, and what a filter
removes at its place in an order is the difference between two neighbouring subsets. Labels are carried the same way.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored
from .quality_rules import words

#: What is counted of every mask: documents, good ones, toxic ones.
COUNTED = ("n", "good", "toxic")


def failures(text: Column, counts: Column) -> dict[str, Column]:
    """The filters that look at one text, whose words ``counts`` has (n, different). Failing means that the document would go.

    A: under 200 words; B: under half of its words are different; C: over 2 % of its code points are among A to Z; D: holds one of
    ``#$%&*|``. An empty text fails A only.
    """
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": counts["n"] < 200, "B": 100 * counts["different"] < 50 * counts["n"], "C": 100 * capitals > 2 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's failures as one row: ``row`` (a struct of the input's other columns and the id) and ``mask``.

    Bits 0 to 3 are A to D of :func:`failures`; bit 4 is E: the same text as a document with a smaller id. Texts meet by their
    sha256 only. The smallest id of each text comes from a minimum that combines before the shuffle and is stored, so rows meet it
    in a join of two plain tables, whose large keys Spark can split. A null id is smaller than none and has none smaller; rows that repeat with
    one id do not fail E by each other. Null texts count as empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    others = [c for c in docs.columns if c != text_col]

    counts = let(words(F.col("_t")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different")))
    whole = docs.select(F.struct(*[F.col(c) for c in others]).alias("row"), F.col(id_col).alias("_id"), text.alias("_t")).withColumn("_counts", counts)
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures(F.col("_t"), F.col("_counts")).values())]
    rows = whole.select("row", "_id", F.unhex(F.sha2("_t", 256)).alias("_text"), (bits[0] + bits[1] + bits[2] + bits[3]).alias("_four"))
    first = stored(docs.filter(F.col(id_col).isNotNull()).groupBy(F.unhex(F.sha2(text, 256)).alias("_text")).agg(F.min(id_col).alias("_first")), "first-ids")
    late = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))
    return rows.join(first, "_text", "left").select("row", (F.col("_four") + F.when(late, 16).otherwise(0)).cast("int").alias("mask"))


def mask_counts(masked: DataFrame, filters: int, *parts: str) -> DataFrame:
    """By part, for each of :data:`COUNTED` an array with one count for every mask. Needs ``mask``, ``good`` and ``toxic``."""
    by_mask = masked.groupBy(*parts, "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    each = lambda c: ", ".join(f"coalesce(sum({c}) FILTER (WHERE mask = {m}), 0L)" for m in range(1 << filters))
    return by_mask.groupBy(*parts).agg(*[F.expr(f"array({each(c)})").alias(c) for c in COUNTED])


def zeta(counts: Column, filters: int) -> Column:
    """At every mask the sum over all its subsets: one pass for each bit."""

    def added(bit: int):
        return lambda a: F.transform(a, lambda x, m: F.when(m.bitwiseAND(F.lit(bit)) != 0, x + F.get(a, m - bit)).otherwise(x))

    for b in range(filters):
        counts = let(counts, added(1 << b))
    return counts


def survivors(counts: Column, filters: int) -> Column:
    """At every subset of filters, how many documents fail none of them: those whose mask lies within the other filters."""
    everything = (1 << filters) - 1
    return let(zeta(counts, filters), lambda z: F.transform(z, lambda _, s: F.get(z, everything - s)))


def _orders(names: str) -> Column:
    """All orders and their steps, with the subsets before and after the step."""
    bit = {c: 1 << i for i, c in enumerate(names)}
    steps = []
    for order in map("".join, permutations(names)):
        before = 0
        for k, c in enumerate(order, 1):
            steps.append((order, k, before, before | bit[c], bit[c]))
            before |= bit[c]
    return F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","k":{k},"b":{b},"a":{a},"f":{f}}}' for o, k, b, a, f in steps) + "]"), "array<struct<o:string,k:int,b:int,a:int,f:int>>")


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The five filters in all 120 orders: one row per part, order and step, zeros included.

    ``kept`` is what survives the step, ``removed`` what it takes, ``redundant`` what fails its filter but went before,
    ``unique_fails`` what fails its filter alone, ``good_lost`` and ``toxic_lost`` the labelled documents among the removed, and
    ``shapley`` the sum of what its filter removes over all orders: every subset before it counts as often as orders have it.

    A null part is the empty string. A document with several labels is good (toxic) if one of them says so; without one it is
    neither. An empty table has no part, so no rows. Columns of any names may stand beside those used.
    """
    names, n = "ABCDE", 5
    said = stored(labels.groupBy(F.col("doc_id").alias("_labelled")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic")), "labelled")
    flat = masks(docs, id_col).select(F.coalesce(F.col("row")[part_col].cast("string"), F.lit("")).alias("part"), F.col("row")[id_col].alias("_id"), "mask")
    masked = flat.join(said, F.col("_id") == F.col("_labelled"), "left")
    counted = mask_counts(masked, n, "part")
    alive = counted.select("part", *[survivors(F.col(c), n).alias(c) for c in COUNTED])
    taken = lambda c, before, after: F.get(F.col(c), before) - F.get(F.col(c), after)
    all_five = (1 << n) - 1

    def shapley(b: int) -> Column:
        """What filter ``b`` removes after every subset without it, times the orders that begin with that subset."""
        times = lambda s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())
        return F.expr(" + ".join(f"{times(s)} * (n[{s}] - n[{s | 1 << b}])" for s in range(1 << n) if not s >> b & 1))

    shares = alive.withColumn("shares", F.array(*[shapley(b) for b in range(n)]))
    step = shares.select("*", F.explode(_orders(names)).alias("s"))
    before, after, bit = F.col("s.b"), F.col("s.a"), F.col("s.f")
    removed = taken("n", before, after)
    return step.select(
        "part",
        F.col("s.o").alias("filter_order"),
        F.col("s.k").alias("step"),
        F.get("n", after).alias("kept"),
        removed.alias("removed"),
        (taken("n", F.lit(0), bit) - removed).alias("redundant"),
        taken("n", all_five - bit, F.lit(all_five)).alias("unique_fails"),
        taken("good", before, after).alias("good_lost"),
        taken("toxic", before, after).alias("toxic_lost"),
        F.get("shares", F.log2(bit.cast("double")).cast("int")).alias("shapley"),
    )


#: DuckDB SQL for the query: every document walks every order.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * len(t),
     'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS x
  FROM w LEFT JOIN l USING (doc_id)),
e AS (SELECT part, good, toxic, [x.A, x.B, x.C, x.D, x.E] AS fails, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
p AS (SELECT filter_order, step, substr(filter_order, step, 1) AS c FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
q AS (
  SELECT part, filter_order, step, c, good, toxic, n, fails[ascii(c) - 64] AS bad,
    len(list_filter(range(1, step), lambda k: fails[ascii(substr(filter_order, k, 1)) - 64])) > 0 AS gone,
    len(list_filter(fails, lambda y: y)) AS how_many
  FROM e, p),
r AS (
  SELECT part, filter_order, step::INTEGER AS step, c, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad AND how_many = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (bad AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (bad AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM q GROUP BY part, filter_order, step, c)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM r
"""
