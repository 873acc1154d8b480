"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__

SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="session")
def duck(smoke):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(smoke):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{smoke}/{f}{'/*' if os.path.isdir(f'{smoke}/{f}') else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, duck, smoke, name):
    df = __spark_entry__.queries()[name](spark, smoke)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda rows: sorted((repr(r) for r in rows))
    assert key(tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()) == key(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["w1", "w2", "cnt", "p", "k"]


def test_every_query_has_sql_but_the_named_ones():
    no_sql = {"viterbi_best", "segment_enumerate_top", "turn_convert"} | {q for q in __spark_entry__.queries() if q.startswith("op") or q == "pipeline"}
    assert __spark_entry__.queries().keys() - SQL.keys() <= no_sql
