"""Every registered query against its SQL, on whole tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SQL, QUERIES = entry.oracle_sql(), entry.queries()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in glob.glob(small + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    assert len(entry.entry(spark).take(1)) == 1
