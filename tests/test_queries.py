"""Every door query against its SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from plumbline.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    return None if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_against_sql(spark, duck, name):
    got = q.queries()[name](spark, SF)
    want = duck.sql(q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert a == b
