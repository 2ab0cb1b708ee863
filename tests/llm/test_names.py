"""Stages keep extra columns of any name, and a text column of another name; samples stay bounded where ids repeat."""

from ledgerloom.llm import decontam, langid, line_dedup, near_dedup, pii, quality_rules

LONG = " ".join(f"word{i} says thing{i}." for i in range(60))
EXTRA = "_row long, row string, doc string, _hit int, _kept int, clean_text string, kept string, id string, dropped int"


def table(spark, text="text"):
    return spark.createDataFrame([(i, LONG if i < 3 else LONG.replace("word", f"w{i}x"), 7, "r", "d", 1, 2, "c", "k", "i", 5) for i in range(6)], f"doc_id long, {text} string, {EXTRA}")


def test_clashing_columns_stay(spark):
    bench = spark.createDataFrame([("b", " ".join(LONG.replace("word", "w4x").split()[:12]))], "item_id string, text string")
    for out, ids in (
        (near_dedup.one_of_each(table(spark), percent=80), [0, 3, 4, 5]),
        (decontam.clean_only(table(spark), bench), [0, 1, 2, 3, 5]),
        (quality_rules.rejected_removed(table(spark)), [0, 1, 2, 3, 4, 5]),
        (pii.redacted(table(spark)), [0, 1, 2, 3, 4, 5]),
        (line_dedup.lines_removed(table(spark)), [0, 1, 2, 3, 4, 5]),
    ):
        assert out.columns == table(spark).columns
        rows = sorted(out.collect())
        assert [r.doc_id for r in rows] == ids
        assert all(tuple(r)[2:] == (7, "r", "d", 1, 2, "c", "k", "i", 5) for r in rows)


def test_text_columns_of_other_names(spark):
    out = quality_rules.rejected_removed(table(spark, "body"), "body")
    assert sorted(r.body for r in out.collect()) == sorted(r.body for r in table(spark, "body").collect())


def test_one_text_an_id_in_the_language_sample(spark):
    rows = [(1, f"text number {i} of one id", "en") for i in range(500)] + [(4, "ein anderer Text", "de")]
    got = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got == {"en": " text number 0 of one id", "de": " ein anderer Text"}
