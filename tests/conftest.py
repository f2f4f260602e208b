from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orderscope.session import local_session  # noqa: E402
from orderscope.sources.tables import Tables, load_tables  # noqa: E402

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", shuffle_partitions=8, driver_memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf001(spark) -> Tables:
    return load_tables(spark, SF001)


# Schemas for hand-made fixtures: every column the summaries read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_type string, p_brand string",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
               "o_orderpriority string, o_orderdate timestamp_ntz, o_totalprice double"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"),
}

DAY = dt.datetime(2020, 1, 15)


def make_tables(spark, **rows) -> Tables:
    """Tables from row tuples in the column order of SCHEMAS; tables not
    given are empty."""
    frames = {name: spark.createDataFrame(rows.get(name, []), schema)
              for name, schema in SCHEMAS.items()}
    return Tables.of(spark, **frames)
