"""The audit against documents that walk every order one by one."""

import re
from itertools import permutations

from ledgerloom.llm import filter_audit as fa


def fails(i, text, everything):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(ws) < 200,
        "B": 100 * len(set(ws)) < 50 * len(ws),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t in everything),
    }


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    everything = [(i, t) for i, t, _ in docs]
    rows = [(s or "", i, fails(i, t or "", everything)) for i, t, s in docs]
    out = {}
    for part in {s for s, _, _ in rows}:
        here = [(i, f) for s, i, f in rows if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = here
            for k, c in enumerate(order, 1):
                gone = [(i, f) for i, f in alive if f[c]]
                alive = [(i, f) for i, f in alive if not f[c]]
                shapley[c] += len(gone)
                out[part, "".join(order), k] = [
                    len(alive), len(gone), sum(f[c] for _, f in here) - len(gone), sum(f[c] and sum(f.values()) == 1 for _, f in here), sum(i in good for i, _ in gone if i is not None), sum(i in toxic for i, _ in gone if i is not None),
                ]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_walks(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, long, "x"), (2, long, "x"), (3, long, None), (None, long, "y"), (4, None, ""), (5, "", "x"), (6, "ABC " * 300, "x"), (7, long + " #", "y"), (7, long + " #", "y"), (8, "a b " * 400_000, "x"), (9, "Ä" * 50 + " É$", "z")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (5, 0, 1), (6, None, None), (99, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, 3, "m") for r in docs], "doc_id long, text string, source string, n int, mask string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in fa.audit(d, lab).collect()}
    assert got == brute(docs, labels)
    assert fa.audit(d.limit(0), lab).collect() == []
    assert sum(v[1] for (p, _, _), v in got.items() if p == "x") == sum(fa_v[6] for (p, o, k), fa_v in got.items() if p == "x" and o == "ABCDE")
