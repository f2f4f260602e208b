"""Ad-hoc SQL over the registered tables (Q16).

``run_sql`` is ``spark.sql`` over temp views with bare table names: the
text is parsed, analysed and optimised by Catalyst like any DataFrame
plan, and the result is returned lazy — nothing is collected, and there is
no row cap. Values are passed as named parameters (``:name``), never
pasted into the text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from orderscope.sources.tables import Tables, table_views

# An ad-hoc question: how many large orders of one status were placed since a
# date, by priority, and how large the largest is.
LARGE_ORDERS = """
SELECT o_orderpriority AS priority, count(*) AS large_orders, max(o_totalprice) AS largest
FROM orders
WHERE o_orderstatus = :status AND o_totalprice >= :at_least AND o_orderdate >= :since
GROUP BY o_orderpriority
HAVING count(*) >= :seen
"""
LARGE_ORDERS_ARGS = {"status": "F", "at_least": 100_000.0, "since": dt.date(1995, 1, 1), "seen": 1}


def run_sql(spark: SparkSession, text: str, args: Mapping[str, object] | None = None,
            tables: Tables | None = None) -> DataFrame:
    """Run a user's SQL text. With ``tables``, they are views under their bare
    names while the text is analysed and no longer: the result's plan holds
    the tables themselves. A temp view of one of these names that is there
    already is an error; it is not replaced."""
    bound = dict(args) if args else None
    if tables is None:
        return spark.sql(text, args=bound)
    with table_views(tables):
        return tables.spark.sql(text, args=bound)


def large_orders_by_priority(t: Tables) -> DataFrame:
    """Q16: :data:`LARGE_ORDERS` with its parameters over the tables."""
    return run_sql(t.spark, LARGE_ORDERS, LARGE_ORDERS_ARGS, tables=t)
