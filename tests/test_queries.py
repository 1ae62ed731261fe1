"""Every query with SQL against DuckDB over the same tables."""

import math

import duckdb
import pytest

from gridlens.plans import catalog
from gridlens.session import TABLES

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted(tuple(map(plain, r)) for r in found.select(*columns).collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
