"""Every registered query equals its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from barlens.plans.oracles import ORACLES
from barlens.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def value(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def test_names():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_query(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(repr([value(r[c]) for c in columns]) for r in frame.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr([value(r[i]) for i in order]) for r in rel.fetchall())


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
