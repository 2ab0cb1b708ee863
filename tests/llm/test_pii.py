import hashlib
import random
import re

import pytest

from ledgerloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    ds = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(ds)) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            n = len(re.sub("[^0-9]", "", m[0]))
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= n <= 19 and luhn(m[0])) or kind == "phone" and not 8 <= n <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def scorer(spark):
    return pii.Scorer(spark)


TEXTS = [
    None,
    "",
    "no data here, é only",
    "é🙂 a@b.co,c.d+e@f-g.h.i@j.k a@@b.c a@b x@y.z.",
    "1.2.3.4.5.6.7.8 999.1.2.3 0255.00.1.1 256.1.1.1",
    "4111 1111 1111 1111, 4111111111111112 and 4111111111111111 4111111111111111",
    "+1 (743) 555-3824 +12 345 +1+2 +49 30 1234567 1.1.1.1",
    "a" * 20_000 + "@" + "b." * 3000,
    "1" * 20_000,
    "mail ann at home dot com or call (212) 555-0199.",
]


def test_base_equals_brute_force(spark, scorer):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, TEXTS[3], None)], "doc_id long, text string, row string")
    rows = pii.find_pii(df, scorer=scorer).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert [f"{x.kind}:{x.s}:{x.e}" for x in r.base] == base(r.row.text or "")
    digest = {r.doc_id: r for r in pii.pii_digest(df).collect()}
    assert digest[3].base_sha256 == hashlib.sha256(",".join(base(TEXTS[3])).encode()).hexdigest()
    assert digest[0].spans == ""
    assert pii.find_pii(df.limit(0), scorer=scorer).collect() == []


def test_candidates_are_told_apart(spark, scorer):
    rows = pii.labelled(spark, 3000).withColumn("p", scorer.score(pii.F.col("c"))).filter("part = 3").collect()
    right = sum((r.p >= scorer.thresholds[r.c.kind]) == bool(r.label) for r in rows)
    assert right >= 0.9 * len(rows)


def test_method_adds_and_redaction_replaces(spark, scorer):
    df = spark.createDataFrame([(1, "call (212) 555-0199, or cards 4111111111111111 4111111111111111 é", 3), (2, "version 1.2.3, order 212-55-0199", 3), (3, None, 3)], "doc_id long, text string, s long")
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert got == {1: "call <PHONE>, or cards <CARD> <CARD> é", 2: "version 1.2.3, order 212-55-0199", 3: None}


def test_many_spans_in_one_text(spark, scorer):
    n = 50_000
    big = "x1@yy.com " * n
    df = spark.createDataFrame([(1, big), (2, "1.2.3.4 or (212) 555-0199 " * 600)], "doc_id long, text string")
    rows = {r.row.doc_id: r for r in pii.find_pii(df, scorer=scorer).collect()}
    assert [(x.s, x.e) for x in rows[1].base] == [(10 * i, 10 * i + 9) for i in range(n)]
    assert [f"{x.kind}:{x.s}:{x.e}" for x in rows[2].base] == base(rows[2].row.text)
    got = {r.doc_id: r.text for r in pii.redacted(df, scorer=scorer).collect()}
    assert got[1] == "<EMAIL> " * n
    for x in reversed(sorted([*rows[2].base, *rows[2].added], key=lambda x: x.s)):
        t = rows[2].row.text if x.s == max(y.s for y in [*rows[2].base, *rows[2].added]) else t  # noqa: F821
        t = t[: x.s] + f"<{x.kind.upper()}>" + t[x.e :]
    assert got[2] == t


def test_choice_among_overlaps_equals_brute_force(spark):
    r = random.Random(9)
    for n in (0, 1, 2, 12, 900):
        spans = set()
        for k in range(4):  # spans of one kind do not overlap
            at = r.randrange(10)
            while len(spans) < n * (k + 1) / 4:
                e = at + r.randrange(7, 40)
                spans.add((at, e, "abcd"[k], r.choice([0.5, 0.6, 0.7])))
                at = e + r.randrange(0, 9)
        spans = sorted(spans)
        meets = lambda x, y: x[0] < y[1] and y[0] < x[1]
        rank = lambda x: (-x[3], x[0] - x[1], x[0], x[2])
        want = [(x[2], x[0], x[1]) for x in spans if not any(meets(x, y) and rank(y) < rank(x) for y in spans)]
        df = spark.createDataFrame([(spans,)], "c array<struct<s:int,e:int,kind:string,p:double>>")
        assert [tuple(x) for x in df.select(pii._likeliest(pii.F.col("c")).alias("x")).first().x] == want


def test_spans_equal_a_plain_search(spark, scorer):
    """The whole query against plain Python: candidates by the same patterns, scores from the same trees."""
    text = "call (212) 555-0199 or 212.555.0188, cards 4111111111111111 4111111111111111 and 4111 1111 1111 1112, ssn 212-55-0199, iban DE44 5001 0517 5407 3249 31, v 1.2.3.4 é🙂 at ann at home dot com, order 000-12-3456"
    df = spark.createDataFrame([(i, text[i:]) for i in range(0, 200, 7)], "doc_id long, text string")
    rows = pii.find_pii(df, scorer=scorer).collect()
    found = [(r.row.doc_id, k, m.start(), m.end(), m[0], r.row.text[max(0, m.start() - 32) : m.start()], r.row.text[m.end() : m.end() + 8]) for r in rows for k, (p, _) in pii.GENERATORS.items() for m in re.finditer(p, r.row.text)]
    made = spark.createDataFrame([(d, s, e, (k, v, b, a)) for d, k, s, e, v, b, a in found], "d long, s int, e int, c struct<kind:string,v:string,before:string,after:string>")
    score = {(x.d, x.c.kind, x.s, x.e): x.p for x in made.withColumn("p", scorer.score(pii.F.col("c"))).collect()}
    for r in rows:
        bases = [(x.s, x.e) for x in r.base]
        assert [f"{x.kind}:{x.s}:{x.e}" for x in r.base] == base(r.row.text)
        free = [(k, s, e, p) for (d, k, s, e), p in score.items() if d == r.row.doc_id and p >= scorer.thresholds[k] and not any(s < y and x < e for x, y in bases)]
        rank = lambda c: (-c[3], c[1] - c[2], c[1], c[0])
        want = {c[:3] for c in free if not any(o[1] < c[2] and c[1] < o[2] and rank(o) < rank(c) for o in free)}
        assert {(x.kind, x.s, x.e) for x in r.added} == want
    assert any(r.added for r in rows)
