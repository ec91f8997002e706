"""Every query of the engine against its SQL in DuckDB, on whole tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest
from paperloom import catalog


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (float, Decimal)):
        return round(float(value), 5)
    return list(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([plain(v[i]) for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, small, name):
    got = catalog.QUERIES[name](spark, small)
    want = duck.sql(catalog.ORACLES[name])
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_every_query_is_registered_with_the_driver():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
