"""Every registered query against its independent DuckDB SQL (sf0.01)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from compare import compare, duck
from conftest import SF0001, SF001
from orderscope.plans.registry import QUERIES as NAMES

# The library's own queries; an optional part tests its own.
QUERIES = {name: entry_module.queries()[name] for name in NAMES}
ORACLE = {name: sql for name, sql in entry_module.oracle_sql().items() if name in NAMES}


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["region", "nation", "order_count", "total_revenue"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    problems = compare(QUERIES[name](spark, SF001), con, ORACLE[name])
    assert not problems, problems


@pytest.mark.parametrize("name", ["revenue_by_region", "top_customers_by_order_count",
                                  "market_segment_analysis", "supplier_performance"])
def test_matches_oracle_smallest_scale(spark, name):
    problems = compare(QUERIES[name](spark, SF0001), duck(SF0001), ORACLE[name])
    assert not problems, problems
