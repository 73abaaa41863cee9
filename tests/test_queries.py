"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from scorewright.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    out = duck.sql(SQL[name])
    assert sorted(out.columns) == cols
    want = sorted((tuple(plain(dict(zip(out.columns, r, strict=True))[c]) for c in cols) for r in out.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, abs=2e-6) if isinstance(y, float) else y)


#: The invented prose of the tables names no metric; test_whole_tables.py holds these two against texts that do.
WORDLESS = {"link_claims_extracted", "numeric_change_checks"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert (QUERIES[name](spark, DATA).count() == 0) == (name in WORDLESS)
