"""Operators that SQL can express, against it."""

import duckdb
import pytest

from partlens.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_operator_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    r = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert sorted(tuple(map(str, x)) for x in df.collect()) == sorted(tuple(str(x[i]) for i in at) for x in r.fetchall())
