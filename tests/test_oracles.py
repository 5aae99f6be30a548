"""Every query with an oracle gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tesserae.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    if isinstance(value, (bool, str)):
        return value
    try:
        return round(float(value), 5)
    except (TypeError, ValueError):
        return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    assert len(found)
    if name in registry.ORACLES:
        expected = duck.execute(registry.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)


def test_merge_has_every_order(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice").toPandas()
    assert rows(registry.QUERIES["U1_merge"](spark, SF).toPandas()) == rows(orders)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert not math.isnan(len(__spark_entry__.queries()))
