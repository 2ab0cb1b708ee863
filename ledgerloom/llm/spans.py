"""Spans of patterns with their places, and trained trees as expressions: DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<s:int,e:int,v:string>>"


#: Elements of an array that a running value is computed over at once, and characters of a piece of text.
RUN, PIECE = 64, 512


def running(values: Column, zero: Column, op, levels: int = 3) -> Column:
    """The running ``op`` (of two integers) over an array.

    An array cannot grow in place, so adding to it one by one takes quadratic time. Here runs of ``RUN`` elements are gone
    through one by one, and runs start from the running value over the runs before, which is found in the same way:
    linear for ``RUN ** (levels + 1)`` elements, over 16 million.
    """

    def plain(xs: Column, first: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out"))
        return F.aggregate(xs, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def wide(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda i: F.slice(xs, i * RUN + 1, F.lit(RUN)))

        def joined(rs: Column) -> Column:
            before = running(F.transform(rs, lambda r: F.aggregate(r, zero, op)), zero, op, levels - 1)
            return let(before, lambda bs: F.flatten(F.transform(rs, lambda r, i: plain(r, F.when(i == 0, zero).otherwise(F.get(bs, i - 1))))))

        return let(runs, joined)

    if not levels:
        return plain(values, zero)
    return let(values, lambda xs: F.when(F.size(xs) <= RUN, plain(xs, zero)).otherwise(wide(xs)))


def find(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as structs: start, end (code points, end exclusive) and value.

    Splitting by a pattern gives what stands between its matches, so places are running sums: linear in the number of
    matches. ``gate`` is a cheap test without which the pattern is not tried.
    """
    total = lambda a, x: a + x

    def placed(x: Column) -> Column:
        ends = running(F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["found"])), x["found"], lambda g, m: F.length(g) + F.length(m)), F.lit(0), total)
        return F.zip_with(x["found"], ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("v")))

    found = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern).alias("gaps")), placed)
    return F.when(text.rlike(pattern) if gate is None else gate, found).otherwise(F.array().cast(SPAN))


def pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` characters, in which a place is found without counting from the text's start."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))


def cut(held: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a text in :func:`pieces`; empty if ``end`` is not after ``start``."""
    at = lambda x: F.floor(x / PIECE).cast("int")
    lo = F.greatest(start, F.lit(0))
    part = lambda k: F.substring(F.get(held, k), F.greatest(lo - k * PIECE, F.lit(0)) + 1, F.least(end - F.greatest(lo, k * PIECE), F.lit(PIECE)))
    several = F.array_join(F.transform(F.sequence(at(lo), F.greatest(at(lo), at(end - 1))), part), "")
    return F.when(end <= lo, "").otherwise(several)


def around(held: Column, span: Column, before: int, after: int) -> tuple[Column, Column]:
    """The characters before and after a span of a text in :func:`pieces`."""
    return cut(held, span["s"] - before, span["s"]), cut(held, span["e"], span["e"] + after)


def apart(spans: Column, others: Column) -> Column:
    """The spans that meet none of the others (arrays of structs with s and e), in order of their starts.

    Both are sorted together; a span meets an earlier one if the running maximum of ends passes its start, and a later one
    if the next start lies before its end.
    """
    kind = lambda xs, k: F.transform(xs, lambda x, i: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), i.alias("i")))
    low, larger = F.lit(-2147483647), lambda a, x: F.greatest(a, x)

    def free(xs: Column) -> Column:
        ends = running(F.transform(xs, lambda x: F.when(x["k"] == 1, x["e"]).otherwise(low)), low, larger)
        next_ = F.reverse(running(F.transform(F.reverse(xs), lambda x: F.when(x["k"] == 1, -x["s"]).otherwise(low)), low, larger))
        known = F.arrays_zip(xs.alias("x"), ends.alias("to"), next_.alias("from_"))
        return F.filter(known, lambda z: (z["x"]["k"] == 0) & (z["to"] <= z["x"]["s"]) & (-z["from_"] >= z["x"]["e"]))

    places = let(F.sort_array(F.concat(kind(spans, 0), kind(others, 1))), free)
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(F.transform(places, lambda z: F.get(spans, z["x"]["i"])))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn sum."""

    def total(d: Column) -> Column:
        each = F.transform(F.split(F.reverse(d), ""), lambda c, i: let(F.try_to_number(c, F.lit("9")).cast("int"), lambda n: F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))

    return F.coalesce(let(digits(value), total) % 10 == 0, F.lit(False))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the given order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def assemble(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    flat = df.select("label", "part", *[f.cast("double").alias(n) for n, f in features.items()])
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(flat)


def tree_sum(debug: str, features: list[Column]) -> Column:
    """The weighted sum of a tree ensemble's predictions, as an expression over its features.

    ``debug`` is what ``toDebugString`` of the fitted model says. Being an expression, it needs no rows of its own: it can be
    applied to structs within an array, and runs where the text is.
    """
    trees: list[tuple[float, list[str]]] = []
    for line in debug.splitlines():
        if m := re.match(r"\s*Tree \d+ \(weight ([-\d.eE]+)\):", line):
            trees.append((float(m[1]), []))
        elif trees and line.strip():
            trees[-1][1].append(line.strip())

    def node(lines: list[str]) -> Column:
        line = lines.pop(0)
        if m := re.match(r"Predict: ([-\d.eE]+)", line):
            return F.lit(float(m[1]))
        m = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line)
        low = node(lines)
        lines.pop(0)  # Else
        return F.when(features[int(m[1])] <= float(m[2]), low).otherwise(node(lines))

    return reduce(lambda a, b: a + b, [weight * node(lines) for weight, lines in trees])
