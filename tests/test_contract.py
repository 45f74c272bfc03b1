"""The driver's contract: every query runs, and agrees with its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from arborsim.plans import queries as catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def values(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    rows = got.collect()
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert values(rows, got.columns) == values(want.fetchall(), want.columns)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
