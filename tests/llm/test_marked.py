"""Secrets and personal data marked by hand in the documents of sf0.01: every candidate there was read with its surroundings."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pii, secrets

SF = "/root/testdata/sf0.01"
#: (doc_id, start, end) of all secrets among the 205 candidates; the others are long words, card numbers and parts of addresses.
SECRETS = [
    (22, 75, 115),
    (171, 4484, 4524),
    (182, 1384, 1424),
    (454, 4382, 4422),
    (460, 430, 470),
    (590, 160, 200),
    (627, 651, 691),
    (661, 269, 309),
    (702, 4382, 4422),
    (764, 205, 245),
    (764, 305, 345),
    (855, 2353, 2393),
    (994, 939, 979),
]
#: Card numbers beside each other, which the base rules leave out: (doc_id, kind, text), each twice in its document.
BESIDE = [(254, "card", "4465758382889437"), (402, "card", "4465758382889437")]
#: Numbers that look like cards and are none (their check digit is wrong): (doc_id, text).
NO_CARDS = [(43, "2123465659789240"), (627, "5731080387325255"), (646, "9870157079875996"), (786, "8007782375593431"), (826, "8646308210557563"), (950, "2744757332971694")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def test_secrets_marked_by_hand(docs):
    """Precision and recall of the forest on real candidates."""
    rows = secrets.scan(docs).select("row.doc_id", F.explode("findings").alias("f")).collect()
    found = {(r.doc_id, r.f.s, r.f.e) for r in rows if r.f.secret}
    right = found & set(SECRETS)
    assert len(rows) >= 205
    assert len(right) >= 0.95 * len(SECRETS) and len(right) >= 0.95 * len(found)


def test_personal_data_marked_by_hand(docs):
    """What the method adds to the base rules, and what it leaves alone."""
    rows = {r.row.doc_id: r for r in pii.find_pii(docs).collect()}
    added = sorted((i, x.kind, r.row.text[x.s : x.e]) for i, r in rows.items() for x in r.added)
    assert added == sorted(2 * BESIDE)
    for i, number in NO_CARDS:
        r = rows[i]
        at = r.row.text.index(number)
        assert not any(x.s < at + 16 and at < x.e for x in [*r.base, *r.added])
