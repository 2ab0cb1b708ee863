"""Shared lines against plain counts."""

import hashlib
from collections import Counter

from ledgerloom.llm import line_dedup as ld

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def texts():
    own = lambda i: f"Own line {i}\n\nShared É line  \nTail {i % 3}"
    out = {i: own(i) for i in range(12)}
    out |= {20: None, 21: "", 22: "\n", 23: "shared É line", 24: "\tSHARED É LINE\r\nshared é line\nkept", 25: "x" * 200_000 + "\n" + "\n".join(f"row {i}" for i in range(30_000))}
    return out


def table(spark, rows, extra="k1 string, t int, row string"):
    return spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], f"doc_id long, text string, {extra}")


def brute(rows, least=10, first=False):
    docs = list(dict.fromkeys(rows))
    held = Counter()
    for _, t in docs:
        held.update({key(x) for x in (t or "").split("\n")} - {""})
    out, met = [], set()
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            k = key(x)
            if held[k] >= least and not (first and k not in met):
                continue
            met.add(k)
            kept.append(x)
        out.append((i, t, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_digest_equals_plain_counts(spark):
    rows = list(texts().items()) + [(None, "Shared É line"), (5, "another text of the same id")]
    repeats = [(0, texts()[0]), (21, "")]
    got = sorted(map(tuple, ld.line_digest(table(spark, rows + repeats)).collect()), key=str)
    want = [(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, _, n, d, k in brute(rows)]
    assert got == sorted(want + [w for w in want if w[0] == 0 or (w[0] == 21)], key=str)
    assert ld.line_digest(table(spark, [])).collect() == []


def test_place_of_common_keys_does_not_matter(spark):
    rows = list(texts().items())
    want = sorted((i, d) for i, _, _, d, _ in brute(rows))
    for one_in, commonest in ((1, 1000), (1, 1), (1_000_000, 10)):
        got = ld.line_bitmaps(table(spark, rows), one_in=one_in, commonest=commonest)
        assert sorted((r.row.doc_id, r.n_dropped) for r in got.collect()) == want


def test_first_lines_stay_if_asked(spark):
    rows = list(texts().items())
    for one_in in (1, 1_000_000):
        df = table(spark, rows)
        out = ld.lines_removed(df, keep_first=True, min_docs=2, one_in=one_in)
        assert out.columns == df.columns
        assert {r.doc_id: r.text or "" for r in out.collect()} == {i: k for i, _, _, _, k in brute(rows, 2, True)}


def test_runs_are_compressed(spark):
    rows = [(i, "head\nsame a\nsame b\nsame c\nown %d\nsame d" % i) for i in range(10)]
    got = ld.line_bitmaps(table(spark, rows)).first()
    assert [tuple(r) for r in got.dropped] == [(0, 4), (5, 1)] and got.n_dropped == 5
