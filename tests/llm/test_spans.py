"""Span helpers against plain Python."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm import spans


def test_places_and_surroundings(spark):
    r = random.Random(1)
    texts = ["", "abc", "a1b22c333é🙂4 5", "9" * 10, *(" ".join(str(r.randrange(1000)) for _ in range(n)) for n in (70, 5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = df.select("t", spans.find(F.col("t"), "[0-9]+").alias("f"), spans.pieces(F.col("t")).alias("held"))
    shown = found.select("t", "f", F.transform("f", lambda x: F.concat_ws("|", *spans.around(F.col("held"), x, 7, 3))).alias("c"))
    for x in shown.collect():
        want = [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", x.t)]
        assert [tuple(y) for y in x.f] == want
        assert x.c == [x.t[max(0, a - 7) : a] + "|" + x.t[b : b + 3] for a, b, _ in want]


def test_a_text_of_200_000_matches(spark):
    df = spark.createDataFrame([("x1@yy.com " * 200_000,)], "t string")
    found = df.select(spans.find(F.col("t"), r"[a-z0-9]+@[a-z]+\.com").alias("f"))
    x = found.select(F.size("f").alias("n"), F.element_at("f", -1).alias("last")).first()
    assert (x.n, x.last.s, x.last.e) == (200_000, 1_999_990, 1_999_999)


def test_apart_equals_brute_force(spark):
    r = random.Random(2)
    for n, m in ((0, 3), (3, 0), (5, 5), (40, 7), (300, 400)):
        some = lambda k: [(s, s + r.randrange(1, 9)) for s in (r.randrange(0, 20 * (n + 1)) for _ in range(k))]  # noqa: B023, E731
        a, b = some(n), some(m)
        df = spark.createDataFrame([(a, b)], "a array<struct<s:int,e:int>>, b array<struct<s:int,e:int>>")
        got = [tuple(x) for x in df.select(spans.apart(F.col("a"), F.col("b")).alias("x")).first().x]
        assert sorted(got) == sorted(x for x in a if not any(x[0] < y[1] and y[0] < x[1] for y in b))
