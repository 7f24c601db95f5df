"""Registered queries against their SQL."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_query_equals_sql(spark, duck, name):
    rows = entry.queries()[name](spark, DATA)
    ran = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in ran.description]
    assert sorted(columns) == sorted(rows.columns)
    assert Counter(tuple(plain(r[c]) for c in columns) for r in rows.collect()) == Counter(tuple(map(plain, r)) for r in ran.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
