"""Every query that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from glyphsift import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    rows = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    assert mine == sorted(tuple(str(dict(zip(names, r, strict=True))[c]) for c in columns) for r in rows.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
