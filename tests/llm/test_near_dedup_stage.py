"""The pipeline's near-dedup stage against brute force at 0.8."""

import random

import corpus_pipeline
from ledgerloom.llm import near_dedup

from .test_near_dedup import _sets, corpus


def kept_at(rows, percent):
    """Ids of the first row of each component, by brute force."""
    sets, up = [_sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted(low.values())


def test_stage_links_at_80(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, "").collect())
    assert got == kept_at(rows, 80)
    assert got != kept_at(rows, 85)


def test_distance_leaves_out_no_pair_at_80():
    r = random.Random(11)
    far = 0
    for _ in range(4000):
        core = [r.getrandbits(64) for _ in range(80)]
        a, b = (near_dedup.np.array(core + [r.getrandbits(64) for _ in range(10)], near_dedup.np.uint64) for _ in range(2))
        far += (near_dedup.signature(a) != near_dedup.signature(b)).sum() > near_dedup.MAX_DISTANCE
    assert far == 0


def test_one_row_of_each_component_whatever_the_ids(spark):
    words = lambda k, n=60: [f"{k}{i}" for i in range(n)]
    a, b, c, d = (" ".join(words(k)) for k in "abcd")
    near_a = " ".join([*words("a")[:-1], "x"])
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, near_a), (3, a), (None, None), (None, ""), (8, ""), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 3):
        got = near_dedup.one_of_each(df.repartition(parts), percent=80)
        assert got.columns == df.columns
        want = [(3, a), (None, b), (7, c), (7, d), (None, None), (None, ""), (8, ""), (8, "")]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
