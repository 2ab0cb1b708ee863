import random

from ledgerloom.llm import near_dedup


def _sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)], low[find(i)] == d) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(5, 200))]
        for _ in range(r.choice([1, 1, 2, 6, 25])):
            words = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            rows.append((n, " ".join(words)))
            n += 1
    r.shuffle(rows)
    return rows


def test_equals_brute_force_with_edge_cases(spark):
    rows = [*corpus(3), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "One two"), (9005, "one TWO"), (9006, "one two three"), (9007, "a b c d e"), (9007, "a b c d e")]
    df = spark.createDataFrame([(d, t, "x", d) for d, t in rows], "doc_id long, text string, cid string, key long")
    for tile in (1024, 4):
        got = near_dedup.near_duplicates(df, tile=tile).collect()
        assert sorted(map(tuple, got)) == brute(rows)
    kept = near_dedup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _, _, k in brute(rows) if k})


def test_hot_keys_are_split_without_losing_links(spark):
    """All documents quote one long passage, so that very many that are not alike share keys."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for n in range(120):
        own = [f"o{n // 4}-{i}" for i in range(r.randrange(8, 40))] if n % 4 == 0 else own  # noqa: F821
        words = passage + own
        if n % 4:
            words = [*words[:-1], f"x{n}"]
        rows.append((n, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (1024, 8):
        assert sorted(map(tuple, near_dedup.near_duplicates(df, tile=tile).collect())) == brute(rows)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 201)]
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted([(i, 0) for i in range(41)] + [(i, 100) for i in (100, 101, 102)] + [(200, 200), (201, 200)])
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, near_dedup.near_duplicates(df).collect())) == sorted(
        map(str, [r for r in spark.createDataFrame([(None, 2, 5, False), (5, 2, 5, True), (None, 0, None, True)], "doc_id long, n_shingles long, component_id long, kept boolean").collect()])
    )
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []


def test_pairs_within_the_distance_share_a_key():
    r = random.Random(5)
    for _ in range(500):
        a = [r.randrange(65536) for _ in range(near_dedup.VALUES)]
        b = list(a)
        for i in r.sample(range(near_dedup.VALUES), near_dedup.MAX_DISTANCE):
            b[i] += 1
        chunk = lambda x, c: x[c * near_dedup.WIDTH : (c + 1) * near_dedup.WIDTH]
        assert any(sum(x != y for x, y in zip(chunk(a, c), chunk(b, c), strict=True)) <= 1 for c in range(near_dedup.CHUNKS))


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    """Spark takes 60 keys a signature for a few bytes; the broadcast of all keys filled the driver's memory."""
    plans = {}
    plain = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and plain(df, label))
    docs = spark.createDataFrame([(i, f"a b c d e f g {i % 3}") for i in range(9)], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {0, 1, 2}
    assert "SortMergeJoin" in plans["met"] and "Broadcast" not in plans["met"]
