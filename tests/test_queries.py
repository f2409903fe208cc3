"""Every registered query of the archive operators against DuckDB."""

import duckdb
import pytest

from linewright.plans import audits, ordered, outputs, records  # noqa: F401
from linewright.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def rounded(row):
    return tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, duck, name):
    want, got = duck.sql(ORACLES[name]), QUERIES[name](spark, sf_dir)
    assert sorted(want.columns) == sorted(got.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(rounded, got.collect())) == sorted(rounded([r[i] for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
