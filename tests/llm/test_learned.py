import random
import zlib

import numpy as np

from ledgerloom.llm import langid, quality_model
from ledgerloom.llm.common import held_out

SYLLABLES = {"en": ["the", "ing", "and", "th", "er"], "fr": ["eau", "que", "é", "ion", "le"], "de": ["sch", "ung", "ü", "der", "ei"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_automaton_accepts_exactly_the_substrings():
    r = random.Random(2)
    for _ in range(50):
        s = [r.randrange(3) for _ in range(r.randrange(1, 30))]
        go = langid.suffix_automaton(s)
        inside = {tuple(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)}
        for _ in range(60):
            w = tuple(r.randrange(3) for _ in range(r.randrange(0, 6)))
            state = 0
            for c in w:
                state = go[state].get(c, -1) if state >= 0 else -1
            assert (state >= 0) == (w in inside)


def greedy(known, t):
    i = n = 0
    while i < len(t):
        j = i + 1
        while j < len(t) and any(known[k : k + j + 1 - i] == t[i : j + 1] for k in range(len(known))):
            j += 1
        i, n = j, n + 1
    return n


def test_phrases_equal_a_greedy_parse_of_the_whole_text():
    r = random.Random(3)
    samples = {k: text(r, k, 40) for k in SYLLABLES} | {"xx": "a" * 7 + " " + "ab" * 30}
    parser = langid.Parser(samples)
    texts = [text(r, r.choice(list(SYLLABLES)), r.randrange(0, 60)) + r.choice(["", " Ω", "日本 x"]) for _ in range(30)]
    texts += ["a" * 300, "ab" * 200, samples["en"], samples["fr"][20:] + samples["fr"][:20], "日" * 50, ""]
    symbols = [parser.symbols(t) for t in texts]
    want = [[greedy(parser.symbols(samples[lang]).tolist(), t.tolist()) for lang in parser.langs] for t in symbols]
    for stretch in (3, 16, 100, 512):
        assert parser.phrases(symbols, stretch).tolist() == want


def test_long_texts_end():
    r = random.Random(6)
    parser = langid.Parser({k: text(r, k, 400) for k in SYLLABLES} | {"xx": "ab" * 100})
    long = [text(r, "de", 100_000), "ab" * 300_000, "z" * 300_000]
    langs, scores = parser.judge(long)
    assert langs[0] == "de" and langs[1] == "xx" and all(0 <= s <= 1 for s in scores)


def test_large_alphabets_and_many_languages():
    r = random.Random(7)
    alphabets = {"zh": range(0x4E00, 0x5600), "ja": [*range(0x5600, 0x5A00), *range(0x3041, 0x3090)], "ko": range(0xAC00, 0xB400), "en": range(97, 123)}
    draw = lambda k, n: "".join(chr(r.choice(alphabets[k])) for _ in range(n))
    words = {k: [draw(k, 4) for _ in range(300)] for k in alphabets}
    say = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    samples = {k: say(k, 900) for k in alphabets}
    parser = langid.Parser(samples)
    assert parser.width > 2000
    for k in alphabets:
        assert parser.judge([say(k, 40), samples[k]])[0] == [k, k]
    many = langid.Parser({f"l{i}": say("zh" if i % 2 else "en", 100) for i in range(150)})
    assert len(many.judge([say("zh", 30)])[0]) == 1


def test_languages_of_held_out_rows(spark):
    r = random.Random(4)
    rows = [(i, text(r, lang, 80), lang, 1.0) for i, lang in enumerate(r.choice(list(SYLLABLES)) for _ in range(240))]
    rows += [(900, None, "en", 1.0), (901, "123 !!", "en", 1.0), (902, "", None, 1.0), (1, rows[1][1], rows[1][2], 1.0), (None, rows[0][1], "de", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = langid.langid_digest(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    held = [x for x in rows[:240] if by_id[x[0]].held_out]
    assert sum(by_id[i].lang_pred == lang for i, _, lang, _ in held) >= 0.95 * len(held) > 0
    assert all(by_id[i].lang_pred == "und" for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.langid_digest(df.limit(0)).collect() == []
    n = df.filter(held_out(df.doc_id)).count()
    assert n == sum(r.held_out for r in got)


def test_quality_of_held_out_rows(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        t = text(r, "en", 60)
        if i % 3 == 0:
            t = " ".join(w + "***" for w in t.split())
        rows.append((i, t, "x"))
        labels.append((i, int(i % 3 != 0), 0))
    docs = spark.createDataFrame([*rows, (1000, None, "x"), (1001, "", "x"), (5, rows[5][1], "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (1000, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = quality_model.quality_scores(docs, marks).collect()
    assert len(got) == 403
    held = [x for x in got if x.held_out and x.doc_id < 400]
    assert sum(x.predicted == int(x.doc_id % 3 != 0) for x in held) >= 0.95 * len(held) > 0
    assert all(0 <= x.score <= 1 for x in got)
    assert quality_model.quality_scores(docs.limit(0), marks.limit(0)).collect() == []
    assert {x.score for x in quality_model.quality_scores(docs, marks.limit(0)).collect()} == {0.5}


def test_features_do_not_depend_on_neighbours():
    texts = ["One two two", None, "", "three é four four", " \n "]
    together, owner = quality_model.bucketed(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(np.sort(together[owner == i]), np.sort(quality_model.bucketed([t])[0]))


def test_features_are_words_and_character_grams():
    """By a plain loop: as many features as words, 3- to 5-grams of marked words, and words equal to the one before."""
    for t in ("日本語テキスト 日本語テキスト é", "a bb ccc dddd", "", "x", None):
        words = (t or "").split()
        grams = {(n, f" {w} "[i : i + n]) for w in words for n in (3, 4, 5) for i in range(len(w) + 3 - n)}
        count = sum(max(0, len(w) + 3 - n) for w in words for n in (3, 4, 5)) + len(words) + sum(a == b for a, b in zip(words, words[1:], strict=False))
        found = quality_model.bucketed([t])[0]
        assert len(found) == count
        assert abs(len(set(found.tolist())) - len(grams) - len(set(words)) - any(a == b for a, b in zip(words, words[1:], strict=False))) <= 1


def test_fit_takes_one_text_of_an_id_and_bounded_characters(spark):
    docs = spark.createDataFrame([(1, "good text here"), (1, "other text of one id"), (2, "bad *** text"), (2, "bad *** text"), (3, "x " * 5000), (4, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    seen = []

    class Spy(quality_model.Model):
        def __init__(self, texts, labels):
            seen.append(sorted(zip(texts, labels, strict=True)))
            super().__init__(texts, labels)

    model, quality_model.Model = quality_model.Model, Spy
    try:
        quality_model.fit(docs, marks, most_chars=1000)
    finally:
        quality_model.Model = model
    free = {d for d in (1, 2, 3, 4) if zlib.crc32(str(d).encode()) % 4 != 2}
    assert seen[0] == sorted((t, y) for d, t, y in ((1, "good text here", 1), (2, "bad *** text", 0)) if d in free)
