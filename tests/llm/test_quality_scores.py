"""Scores of the quality classifier against a forward pass in plain loops."""

import math
import re

from ledgerloom.llm import quality_model as qm
from ledgerloom.llm.common import held_out, read

SF = "/root/testdata/sf0.001"
WORD = 1 << 64
P = 0x9E3779B97F4A7C15


def bucket(h, salt):
    h = (h + salt) * 0xBF58476D1CE4E5B9 % WORD
    return (h ^ (h >> 31)) % WORD >> 20 & (qm.BUCKETS - 1)


def features(text):
    """Buckets of all grams, words and repeats of a text, one by one."""
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text or "")
    out = []
    for w in words:
        marked = f" {w} "
        for n in qm.GRAMS:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = (h * P + ord(c)) % WORD
                out.append(bucket(h, n))
        out.append(bucket(sum((ord(c) + 1) * pow(P | 1, k, WORD) for k, c in enumerate(w)) % WORD, 99))
    out += [bucket(7, 7) for a, b in zip(words, words[1:], strict=False) if a == b]
    return out


def test_scores_equal_a_plain_forward_pass(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = qm.fit(docs, labels)
    rows = {r.doc_id: r.text for r in docs.orderBy("doc_id").limit(60).collect()} | {-1: "", -2: None, -3: "a", -4: "same same\tsame", -5: "\x0b\x0c \r\n", -6: "Ü 😀 é"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in qm.score(df, model).collect()}
    for i, text in rows.items():
        found = features(text)
        z = sum(float(model.weights[b]) for b in found) / max(1, len(found)) + model.bias
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert math.isclose(got[i].score, want, rel_tol=1e-5, abs_tol=1e-9)
        assert got[i].predicted == int(got[i].score >= 0.7)


def test_query_scores_every_row(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    out = qm.quality_scores(docs, labels)
    assert out.count() == docs.count()
    assert out.filter(out["held_out"] != held_out(out["doc_id"])).count() == 0
    known = {r.doc_id: r.quality for r in labels.collect()}
    tested = [(known[r.doc_id], r.predicted) for r in out.filter("held_out").collect() if r.doc_id in known]
    assert tested and sum(a == b for a, b in tested) / len(tested) > 0.9
