import math

import pytest

from textloom.plans import catalog

duckdb = pytest.importorskip("duckdb")
TABLES = "documents pages conversations events part".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def key(row):
    return tuple((x is not None, str(x)) for x in row)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_same_as_sql(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf)
    want = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    expected = sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=key)
    assert len(rows) == len(expected) > 0
    for a, b in zip(rows, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-15), (name, a, b)
