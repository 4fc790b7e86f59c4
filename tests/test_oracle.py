"""Registered queries against their oracle SQL in DuckDB, on the smallest sample tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DIR}/{f}')")
    return c


def plain(v):
    if v is None or str(v) in ("nan", "<NA>", "NaT", "None"):
        return "None"
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return "None" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.oracle_sql() if k != "pipeline"))
def test_query_equals_oracle(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DIR).toPandas()
    want = duck.execute(__spark_entry__.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
