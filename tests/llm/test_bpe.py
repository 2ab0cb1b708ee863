import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ledgerloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.read_ranks(f.read())


def test_queue_gives_lowest_rank_and_leftmost_place():
    q, model, r = bpe.RankQueue(50_256), [], random.Random(1)
    for _ in range(3000):
        if model and r.random() < 0.45:
            rank = q.lowest()
            assert (rank, q.pop(rank)) == min(model)
            model.remove(min(model))
        else:
            model.append((r.randrange(50_256), r.randrange(10**6)))
            q.push(*model[-1])
    assert q.lowest() == (min(model)[0] if model else -1)


def test_ids_equal_the_library(ranks):
    theirs = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, r = bpe.Codec(ranks, PATTERN, memo_chars=2000), random.Random(7)
    texts = ["", " ", "a" * 5000, "ab" * 3000, "\n" * 300, "日本語 テスト é ß <|endoftext|>", "🙂🙃 ​ x", "1234567 don't we'll", "zq" + "xj" * 999]
    texts += ["".join(r.choice("abcdeé  \n'!1日") for _ in range(r.randrange(400))) for _ in range(300)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_operator_rows(spark, ranks):
    rows = [(1, "Hello  world", "x"), (2, None, "x"), (3, "", "y"), (1, "Hello  world", "x"), (None, "é" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.row.doc_id, r.row.text): r for r in bpe.round_trip(df, PATH, PATTERN).collect()}
    assert got[(2, None)].n_tokens == got[(3, "")].n_tokens == 0
    assert got[(2, None)].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[(None, "é" * 50_000)].decoded_sha256 == hashlib.sha256(("é" * 50_000).encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((r.data.decode() for r in back)) == sorted((t or "") for _, t, _ in rows)
    assert bpe.bpe_digest(df.limit(0)).collect() == []
    assert base64.b64decode(open(PATH, "rb").readline().split()[0]) in ranks
