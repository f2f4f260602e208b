"""Hot keys: one customer, one part and one supplier each holding a third
of all fact rows. Results must stay exact, and the plans must aggregate
the fact table on the hot key before any join moves its rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from compare import TABLES, compare
from conftest import SF001
from orderscope.sources.tables import Tables, load_tables
from test_plans import plan_text

import duckdb

HOT_CUSTOMER, HOT_PART, HOT_SUPPLIER = 7, 11, 3

SKEWED = ["kpi_metrics", "orders_summary", "top_customers", "revenue_by_region",
          "market_segment_analysis", "monthly_trend_by_segment", "top_customers_by_order_count",
          "top_parts_by_revenue", "part_sales_by_type", "supplier_performance",
          "order_fulfillment_metrics", "regional_summary", "segment_revenue_share"]


@pytest.fixture(scope="module")
def skewed(spark) -> Tables:
    base = load_tables(spark, SF001)
    orders = base.orders.withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(HOT_CUSTOMER))
        .otherwise(F.col("o_custkey")))
    lineitem = (base.lineitem
                .withColumn("l_partkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(HOT_PART))
                            .otherwise(F.col("l_partkey")))
                .withColumn("l_suppkey", F.when(F.col("l_orderkey") % 3 == 1, F.lit(HOT_SUPPLIER))
                            .otherwise(F.col("l_suppkey"))))
    frames = dict(base.items())
    frames.update(orders=orders, lineitem=lineitem)
    return Tables.of(spark, **frames)


@pytest.fixture(scope="module")
def skewed_duck():
    con = duckdb.connect()
    for t in TABLES:
        src = f"read_parquet('{SF001}/{t}.parquet')"
        if t == "orders":
            sql = (f"SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN {HOT_CUSTOMER} "
                   f"ELSE o_custkey END AS o_custkey) FROM {src}")
        elif t == "lineitem":
            sql = (f"SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN {HOT_PART} ELSE l_partkey END "
                   f"AS l_partkey, CASE WHEN l_orderkey % 3 = 1 THEN {HOT_SUPPLIER} ELSE l_suppkey END "
                   f"AS l_suppkey) FROM {src}")
        else:
            sql = f"SELECT * FROM {src}"
        con.execute(f"CREATE VIEW {t} AS {sql}")
    return con


def test_hot_keys_really_are_hot(skewed):
    total = skewed.orders.count()
    hot = skewed.orders.filter(F.col("o_custkey") == HOT_CUSTOMER).count()
    assert hot >= total / 3


@pytest.mark.parametrize("name", SKEWED)
def test_exact_under_hot_keys(skewed, skewed_duck, name):
    from orderscope.plans.registry import QUERIES
    problems = compare(QUERIES[name](skewed), skewed_duck, entry_module.oracle_sql()[name])
    assert not problems, problems


@pytest.mark.parametrize("name, key", [("revenue_by_region", "o_custkey"),
                                       ("top_customers_by_order_count", "o_custkey"),
                                       ("market_segment_analysis", "o_custkey"),
                                       ("top_parts_by_revenue", "l_partkey"),
                                       ("part_sales_by_type", "l_partkey")])
def test_hot_key_collapsed_before_the_join(skewed, name, key):
    from orderscope.plans.registry import QUERIES
    text = plan_text(QUERIES[name](skewed), "simple")
    tree = text.split("\n")
    agg_line = next(i for i, line in enumerate(tree)
                    if "HashAggregate(keys=[" + key in line and "partial_" in line)
    join_lines = [i for i, line in enumerate(tree) if "Join" in line]
    # In the printed tree, children come below parents: the partial aggregate
    # on the hot key sits under (before) every join.
    assert all(agg_line > j for j in join_lines)
