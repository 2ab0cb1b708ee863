import hashlib
import random

import numpy as np
import pyarrow.parquet as pq

from ledgerloom.llm import decontam


def folded(text):
    return [w.decode() for w in decontam.words(text)]


def brute(docs, items, size=10):
    phrases = []
    for item, text in items:
        w = folded(text)
        phrases += [(str(item), tuple(w[i : i + size])) for i in range(max(1, len(w) - size + 1))] if w else []
    out = []
    for d, text in docs:
        w, hit, found = folded(text), set(), set()
        for item, p in set(phrases):
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(item)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data(spark):
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(["the", "of", "And", "x1", "é", "ñandú", "rare%d" % r.randrange(30)]) for _ in range(n))
    items = [(i, text(r.randrange(8, 20))) for i in range(12)] + [(90, "Two words"), (91, "single"), (92, None), (93, "..."), (12, "the the the the the the the the the the the"), (94, "Two, WORDS!")]
    docs = []
    for i in range(60):
        parts = [text(r.randrange(0, 30))]
        if i % 3 == 0:
            parts += [r.choice(items)[1] or "", text(5)]
        docs.append((i, " - ".join(parts)))
    docs += [(100, None), (101, ""), (102, "the " * 40), (103, docs[0][1]), (0, docs[0][1]), (None, "so two words here")]
    return docs, items, spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, n_words long, item string"), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark):
    docs, items, d, b = data(spark)
    got = sorted(map(tuple, decontam.decontam_digest(d, b).collect()), key=str)
    assert got == brute(docs, items)
    assert decontam.decontam_digest(d.limit(0), b).collect() == []
    none = decontam.decontam_digest(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)


def test_blocks_of_queries_and_filter(spark):
    docs, items, d, b = data(spark)
    one, many, more = (sorted((str(r.doc_id), r.n_words, r.n_hit, len({m.item for m in r.matches})) for r in decontam.contaminated(d, b, block_phrases=n).collect()) for n in (200_000, 20, 3))
    assert one == many == more
    kept = decontam.clean_only(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((x[0] for x in brute(docs, items) if not x[5]), key=str)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha beta x gamma"), (2, "alpha x x x x x x beta gamma"), (3, "alpha beta gamma"), (4, "gamma"), (5, "beta alpha")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: {m.exact for m in r.matches} for r in decontam.contaminated(d, b, slop=2).collect()}
    assert got == {1: {False}, 2: set(), 3: {True, False}, 4: set(), 5: set()}


def test_null_items_share_phrases(spark):
    d = spark.createDataFrame([(1, "so two words here"), (2, "nothing")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "two words"), (5, "Two words"), (None, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontam_digest(d, b).collect()}
    assert got == {1: (4, 2, 2, hashlib.sha256(b"5").hexdigest(), True), 2: (1, 0, 0, hashlib.sha256(b"").hexdigest(), False)}


def test_stored_index_holds_all_postings(spark):
    docs, _, d, _ = data(spark)
    long = [(7_000, " ".join(f"t{i % 50}" for i in range(3000)))]
    df = d.select("doc_id", "text").unionByName(spark.createDataFrame(long, "doc_id long, text string"))
    rows = decontam.build_index(df, block_words=200).collect()
    found = {}
    for r in rows:
        ends, steps = (np.frombuffer(x, "<i4").tolist() for x in (r.ends, r.steps))
        assert r.terms == sorted(r.terms) and len(ends) == len(r.terms)
        starts = [0]
        for n in r.lengths:
            starts.append(starts[-1] + n + 1)
        text = {}
        for t, a, b in zip(r.terms, [0, *ends], ends, strict=False):
            place = 0
            for step in steps[a:b]:
                place += step
                text[place] = t
        for i, n, at in zip(r.ids, r.lengths, starts, strict=False):
            found.setdefault(str(i), []).append([text[at + k] for k in range(n)])
    want = {}
    for i, t in [*docs, *long]:
        want.setdefault(str(i), []).append(folded(t))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert max(len(r.ids) for r in rows) > 1


def test_a_row_group_holds_few_blocks(spark):
    """Else a reader holds all blocks of a file at once."""
    docs, items, d, b = data(spark)
    index = decontam.build_index(d.coalesce(1), block_words=1)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    assert sum(f.num_rows for f in files) == index.count() > 40
    assert max(f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)) <= 8
