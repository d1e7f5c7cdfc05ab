"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tracefold.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    text = SQL[name].strip()
    columns = list(duck.sql(text).columns)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(columns, duck.sql(text).fetchall())


def test_stream_equals_batch(spark):
    got = {(r.key, r.value, r.length) for r in QUERIES["stream_streaks"](spark, DATA).collect()}
    runs = QUERIES["streaks"](spark, DATA).collect()
    last = {}
    for r in runs:
        if r.user_id not in last or r.run_end > last[r.user_id].run_end:
            last[r.user_id] = r
    assert got == {(str(k), r.event_type, r.length) for k, r in last.items()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8
    assert set(e.oracle_sql()) <= set(e.queries())
