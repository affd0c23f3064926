"""Every query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from partlens.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that SQL can't express; it has a test of its own.
WITHOUT = {"segment_intervals"}


def _norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v).removesuffix(" 00:00:00")
    return f"{x:.5g}" if math.isfinite(x) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def test_all_but_a_few_have_an_oracle():
    assert set(registry.queries()) - set(registry.oracle_sql()) == WITHOUT
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    r = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(_norm(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(_norm(x[i]) for i in at) for x in r.fetchall())
