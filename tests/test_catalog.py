"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from ledgerloom.plans import catalog, further, inference, more, reports  # noqa: F401  (all add to the catalogue)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def shown(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return f"{x:.4f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    ours = catalog.COMPARED[name](spark, SF)
    theirs = duck.sql(catalog.SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in ours.collect())
    names = list(theirs.columns)
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in theirs.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_others_have_rows_and_repeat(spark, name):
    first, second = (sorted(map(str, catalog.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first == second and first
