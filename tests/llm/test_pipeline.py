"""The pipeline against a brute-force version in plain Python, on the smallest tables."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from ledgerloom.llm import bpe

from .test_near_dedup_stage import kept_at
from .test_pii import base

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NOTICES = re.compile(r"all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|(?:enable|requires) javascript|lorem ipsum|subscribe to our newsletter|click here to|log in to comment|skip to content")


def good_text(text):
    """The lines that stay, or None for a rejected document."""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    kept, lost = [], 0
    for line in text.split("\n"):
        n, count = len(WORD.findall(line)), lambda chars: sum(c in chars for c in line)  # noqa: B023
        bad = n and (count("#*$%&|<>") > 0.5 * n or count("!") > 0.5 * n + 2 or count("|»›•·") > 0.3 * n or (n <= 4 and not re.search("[.!?…。！？։؟।:;]", line)) or NOTICES.search(line.lower()))
        if bad:
            lost += n
        else:
            kept.append(line)
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words) or lost > 0.5 * len(words):
        return None
    return "\n".join(kept)


def folded(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def windows(text):
    w = folded(text)
    return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "pii", "byte_bpe"]
    stage = dict(corpus_pipeline.STAGES)
    # Quality rules.
    now = stage["quality_rules"](spark, docs, SF)
    assert now.columns == docs.columns
    want = {d: g for d, t in rows.items() if (g := good_text(t)) is not None}
    assert {r.doc_id: r.text for r in now.collect()} == want
    # One of each group linked at 0.8, the similarity of stages.
    keep = kept_at(sorted(want.items()), 80)
    now = stage["near_dedup"](spark, now, SF).cache()
    assert now.columns == docs.columns
    want = {d: want[d] for d in keep}
    assert {r.doc_id: r.text for r in now.collect()} == want
    # No benchmark phrases.
    items = [windows(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    phrases = set().union(*items)
    assert all(len(p) == 10 for p in phrases)
    want = {d: t for d, t in want.items() if not phrases & windows(t) or len(folded(t)) < 10}
    now = stage["decontamination"](spark, now, SF).cache()
    assert now.columns == docs.columns
    assert {r.doc_id: r.text for r in now.collect()} == want
    # No personal data of the base kinds; texts without any are untouched.
    now = stage["pii"](spark, now, SF).cache()
    assert now.columns == docs.columns
    done = {r.doc_id: r.text for r in now.collect()}
    assert done.keys() == want.keys()
    for d, t in want.items():
        assert base(done[d]) == []
        if not re.search("[0-9@]", t):
            assert done[d] == t
    # Token ids.
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in stage["byte_bpe"](spark, now, SF).collect():
        assert r.ids == theirs.encode_ordinary(done[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(done[r.doc_id].encode()).hexdigest()
