"""The driver contract: every texture query runs and equals its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from grainspan.plans.oracles import ORACLES
from grainspan.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    order = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == order
    at = [rel.columns.index(c) for c in order]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    assert got == want


def test_contract(spark):
    every = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(every) and set(QUERIES) <= set(every) and set(ORACLES) == set(QUERIES)
    assert __spark_entry__.entry(spark).count() > 0
