import os

import duckdb
import pytest

from glyphsift.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(dict(zip(names, r, strict=True))[c]) for c in columns) for r in rows.fetchall())
