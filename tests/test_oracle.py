"""Every query with SQL gives the rows that DuckDB gives on the same small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from jobsieve.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall())
    assert ours == theirs


def test_every_query_is_callable():
    assert all(callable(f) for f in catalogue.queries().values())
    assert catalogue.FLAGSHIP in catalogue.queries()
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
