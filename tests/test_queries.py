"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from parley import queries

SF = "/root/testdata/sf0.001"


def normal(x):
    return str(x) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    return connection


@pytest.mark.parametrize("name", queries.ALL)
def test_query(spark, db, name):
    query, sql = queries.ALL[name]
    df = query(spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert rows
    if sql:
        result = db.sql(sql)
        assert sorted(result.columns) == names
        place = [result.columns.index(c) for c in names]
        assert rows == sorted((tuple(r[i] for i in place) for r in result.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12
    assert set(queries.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
