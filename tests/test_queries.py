"""Each query with SQL, against that SQL, on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, bag

SLOW: set[str] = set()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", [n for n in queries() if n not in SLOW])
def test_query(spark, data, con, name):
    df = queries()[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name in oracle_sql():
        result = con.execute(oracle_sql()[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert bag(df.columns, got) == bag(names, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
