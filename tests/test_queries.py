"""Every query of the library against its SQL on the small tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__
from marlstone.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


def plain(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: "-" if x is None else f"{float(x):.5g}" if isinstance(x, (int, float, decimal.Decimal)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(value(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    if name not in SQL:
        pytest.skip("held to brute force in test_brute.py")
    out = catalog.queries()[name](spark, SF)
    rows = [tuple(r) for r in out.collect()]
    want = duck.execute(SQL[name]).df()
    want = want.astype(object).where(want.notna(), None)
    assert sorted(out.columns) == sorted(want.columns)
    assert plain(rows, out.columns) == plain(want.values.tolist(), list(want.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
