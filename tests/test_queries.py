"""Every registered query of the library runs, and equals its reference SQL where it has one."""

import datetime
import decimal
import math

import duckdb
import pytest

from tesserae.plans import registry
from tesserae.plans.fixtures import TABLES

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def folder(request):
    return f"/root/testdata/{request.param}"


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = rows_of(df.collect(), [df.columns.index(c) for c in columns])
    assert got
    if name in ORACLES:
        res = duck.execute(ORACLES[name])
        names = [c[0] for c in res.description]
        assert sorted(names) == columns
        assert got == rows_of(res.fetchall(), [names.index(c) for c in columns])
