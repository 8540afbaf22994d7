"""Every registered query with SQL gives the rows that an independent engine gives."""

import os

import duckdb
import pytest

from maskwright.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 8)
    return value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLE_SQL[name])
    assert cols == sorted(rel.columns)
    own = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    place = [rel.columns.index(c) for c in cols]
    other = sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=repr)
    assert own == other


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
