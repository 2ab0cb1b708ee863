from ledgerloom.llm import quality_rules as q

PROSE = "One line of plain words that ends well, and says a little more than that."
#: Sentences without a repeated three-word window, so that only the lines decide.
VARIED = [" ".join(f"{w}{i}" for w in PROSE.rstrip(".").split()) + "." for i in range(6)]


def rows(spark):
    long = "\n".join(f"{line} é" for line in VARIED)
    texts = {
        1: long,
        2: None,
        3: "",
        4: " \t\x0b\n\r\n",
        5: long + "\nHome | News | About | Contact\nAll rights reserved.\nMenu",
        6: "\n".join(f"Word{i}*** other{i}### third{i}$$$ fourth{i}%%%" for i in range(40)),
        7: "same same same " * 40,
        8: "\n".join([PROSE] * 6),
        9: "w" * 50_000 + " " + " ".join(f"u{i}" for i in range(20_000)) + ".",
    }
    return texts, spark.createDataFrame([(k, t, "x", True) for k, t in texts.items()] + [(1, texts[1], "x", True), (None, texts[1], None, None)], "doc_id long, text string, row string, kept boolean")


def brute(text):
    text = text or ""
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_measures_and_verdicts(spark):
    texts, df = rows(spark)
    got = q.quality_digest(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id or 1])
    by_id = {r.doc_id: r for r in got}
    assert {k for k, r in by_id.items() if r.kept} == {1, 5, 9, None}
    assert by_id[6].n_words >= 50 and not by_id[6].base_failed and not by_id[6].kept
    assert by_id[7].base_failed and by_id[2].base_failed


def test_filter_keeps_columns_and_cleans(spark):
    texts, df = rows(spark)
    out = q.rejected_removed(df)
    assert out.columns == df.columns
    cleaned = {r.doc_id: r.text for r in out.collect()}
    assert cleaned[5] == texts[1] and cleaned[1] == texts[1]
    assert q.quality_digest(df.limit(0)).collect() == []


def test_notices_go_and_prose_about_them_stays(spark):
    notices = ["© 2024 Beispiel. Alle Rechte vorbehalten.", "Tous droits réservés, société Exemple.", "TODOS LOS DERECHOS RESERVADOS.", "See our Privacy Policy."]
    prose = "The committee asked why the privacy policy of the agency had not been read by anyone, " * 3 + "and nobody could say."
    text = "\n".join([*VARIED, *notices, prose])
    got = q.rejected_removed(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.text == "\n".join([*VARIED, prose])
