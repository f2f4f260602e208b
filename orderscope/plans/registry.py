"""Name → plan for every query the library offers.

Each entry takes a :class:`Tables` bundle and returns a lazy DataFrame.
``QUERIES`` keys match :data:`orderscope.plans.oracle.ORACLE_SQL`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from orderscope.functions.coerce import coerce_numeric
from orderscope.plans import derived as D
from orderscope.plans import outputs as O
from orderscope.plans import summaries as S
from orderscope.plans.adhoc import large_orders_by_priority
from orderscope.sources.tables import Tables, source_check


def revenue_by_region_coerced(t: Tables) -> DataFrame:
    """F10 on Q06 as a text-only connector would deliver it: every column
    arrives as a string and numeric ones are re-typed by ``coerce_numeric``
    (counts come back as double, names stay strings). The columns that were
    numeric are known here, so no pass over the data decides it."""
    q06 = S.revenue_by_region(t)
    numeric = [f.name for f in q06.schema if isinstance(f.dataType, NumericType)]
    as_text = q06.select(*[F.col(c).cast("string").alias(c) for c in q06.columns])
    return coerce_numeric(as_text, numeric)


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # Q01–Q15, Q16, Q17
    "kpi_metrics": S.kpi_metrics,
    "orders_summary": S.orders_summary,
    "orders_by_status": S.orders_by_status,
    "orders_by_priority": S.orders_by_priority,
    "top_customers": S.top_customers,
    "revenue_by_region": S.revenue_by_region,
    "market_segment_analysis": S.market_segment_analysis,
    "top_parts_by_revenue": S.top_parts_by_revenue,
    "supplier_performance": S.supplier_performance,
    "monthly_trend_by_segment": S.monthly_trend_by_segment,
    "order_fulfillment_metrics": S.order_fulfillment_standin,
    "top_customers_by_order_count": S.top_customers_by_order_count,
    "monthly_revenue": S.monthly_revenue,
    "part_sales_by_type": S.part_sales_by_type,
    "preview": S.orders_preview,
    "adhoc_sql": large_orders_by_priority,
    "source_check": source_check,
    # D1–D7 and display / coercion forms
    "regional_summary": D.regional_summary,
    "top_nations": D.top_nations,
    "region_hierarchy": D.region_hierarchy,
    "status_share": D.status_share,
    "segment_revenue_share": D.segment_revenue_share,
    "on_time_rate": D.on_time_rate,
    "kpi_cards": D.kpi_cards,
    "regional_summary_display": D.regional_summary_display,
    "revenue_by_region_coerced": revenue_by_region_coerced,
    # Effects, so these run jobs when they are called
    "csv_round_trip": O.csv_round_trip,
    "snapshot_round_trip": O.snapshot_round_trip,
    "write_reports": O.write_reports,
}
