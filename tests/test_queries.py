"""Every query with a SQL counterpart against DuckDB, on the smallest data."""

import duckdb
import pytest

from pulseloom.plans import registry
from pulseloom.plans.adapters import TABLES
from tools.check import plain

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def close(x, y):
    """Fourth decimals may differ by one: the engines round halves differently."""
    if isinstance(x, float) and isinstance(y, float):
        return abs(x - y) <= 1.01e-4
    return x == y


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = registry.callables()[name](spark, FOLDER)
    names = sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=key)
    theirs = sorted((tuple(plain(v) for v in r) for r in con.execute(f"select {', '.join(names)} from ({SQL[name]})").fetchall()), key=key)
    assert len(ours) == len(theirs)
    assert all(close(x, y) for a, b in zip(ours, theirs) for x, y in zip(a, b))
