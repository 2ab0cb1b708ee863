import hashlib
import random

import numpy as np

from ledgerloom.llm import repeats


def brute(rows, size=200):
    seen, raws = {}, [(d, (t or "").encode()) for d, t in rows]
    for _, raw in raws:
        for i in range(len(raw) - size + 1):
            seen[raw[i : i + size]] = seen.get(raw[i : i + size], 0) + 1
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - size + 1):
            if seen[raw[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((d, len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60), text(41), text(200)]
    rows = []
    for i in range(60):
        parts = [text(r.randrange(0, 60))]
        for _ in range(r.choice([0, 0, 1, 2])):
            s = r.choice(shared)
            lo = r.randrange(0, 20)
            parts += [s[lo : len(s) - r.randrange(0, 20)], text(r.randrange(0, 12))]
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 450), (103, "ab" * 130), (104, "x" * 199), (105, rows[5][1]), (106, text(90)), (106, text(90)), (107, text(70)), (None, rows[7][1])]
    return [*rows, rows[-2]]


def test_equals_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, h string, id long")
    assert sorted(map(tuple, repeats.repeats_digest(df).collect()), key=str) == brute(rows)
    got = repeats.without_repeats(df, most_contexts=1)
    assert sorted(((r.doc_id, sum(s.b - s.a for s in r.removed)) for r in got.collect()), key=str) == sorted(((x[0], x[2]) for x in brute(rows)), key=str)
    assert repeats.repeats_digest(df.limit(0)).collect() == []


def test_anchors_stay_whole_where_joins_are_broadcast_while_they_run(spark):
    rows = corpus(7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "100k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        for most in (16, 18):
            got = repeats.without_repeats(df, most_contexts=most).collect()
            assert sorted(((r.doc_id, sum(s.b - s.a for s in r.removed)) for r in got), key=str) == sorted(((x[0], x[2]) for x in brute(rows)), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_interval_tree_gives_all_maximal_repeats():
    r = random.Random(4)
    for _ in range(30):
        texts = ["".join(r.choice("ab") for _ in range(r.randrange(0, 40))).encode() for _ in range(3)]
        least = 4
        places = {}
        for t, x in enumerate(texts):
            for i in range(len(x)):
                for n in range(least, 41):
                    if i + n <= len(x):
                        places.setdefault(x[i : i + n], []).append((t, i))
        want = set()
        for s, at in places.items():
            lefts = [texts[t][i - 1 : i] for t, i in at]
            rights = [texts[t][i + len(s) : i + len(s) + 1] for t, i in at]
            varied = lambda xs: len(set(xs)) > 1 or xs[0] == b""
            if len(at) > 1 and varied(lefts) and varied(rights):
                want.add((len(s), tuple(sorted(at))))
        got = {(n, tuple(p)) for n, p in repeats.maximal_repeats(texts, [1] * 3, least)}
        assert want == got


def maximal(rows, size):
    """Maximal repeats by extending every pair of places, as (string, places)."""
    raws = [(t or "").encode() for _, t in rows]
    grams = {}
    for d, raw in enumerate(raws):
        for i in range(len(raw) - size + 1):
            grams.setdefault(raw[i : i + size], []).append((d, i))
    found = {}
    for at in grams.values():
        for x in range(len(at)):
            for y in range(x):
                (d, i), (e, j) = at[x], at[y]
                if i and j and raws[d][i - 1] == raws[e][j - 1]:
                    continue
                n = size
                while i + n < len(raws[d]) and j + n < len(raws[e]) and raws[d][i + n] == raws[e][j + n]:
                    n += 1
                found.setdefault(raws[d][i : i + n], set())
    for w in found:
        for d, raw in enumerate(raws):
            k = raw.find(w)
            while k >= 0:
                found[w].add((d, k))
                k = raw.find(w, k + 1)
    return {(len(w), tuple(sorted(p))) for w, p in found.items()}


def test_groups_are_the_maximal_repeats(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    inner, long, other = text(60), text(900), text(80)
    outer = text(70) + inner + text(70)
    rows = [(i, text(20) + p + text(10)) for i, p in enumerate([inner, outer, outer, long, long, long, other, other + "|" + text(3) + "!" + other + "#"])]
    rows += [(20, None), (21, "short"), (22, rows[3][1]), (22, rows[3][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, length int")
    want = maximal(rows, 200)
    for most in (1000, 1):
        found = {}
        for x in repeats.repeat_groups(df, most_contexts=most).collect():
            found.setdefault((x.group, x.length), []).append((x.doc_id, x.start))
        # Rows with one id cannot be told apart in the result.
        ids = [d for d, _ in rows]
        assert sorted((n, sorted(at)) for (_, n), at in found.items()) == sorted((n, sorted((ids[d], i) for d, i in at)) for n, at in want)
    assert repeats.repeat_groups(df.limit(0)).collect() == []
