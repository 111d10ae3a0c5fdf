"""Every registered query against its SQL, at the smallest scale."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from corvane.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = Counter(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in cursor.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
