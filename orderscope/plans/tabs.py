"""Several summaries from one shared, persisted aggregate.

The dashboard draws some summaries side by side from the same data: the
overview shows the KPIs, the monthly trend and the status and priority
breakdowns; the geography view shows revenue by region and nation, its
regional roll-up, the top nations and the region → nation hierarchy; the
segment view shows the segment table and its revenue shares. Computed one
by one, each would scan and aggregate the fact table again.

These context managers aggregate once, ``persist`` the small result (one row
per status, priority and month, per region and nation, or per segment — its
size is bounded by the dimensions, not by the orders) and derive every view
from it; on exit the cache is released. A lost executor only loses cached blocks, which Spark
recomputes from the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderscope.functions.dates import month_start
from orderscope.plans import derived as D
from orderscope.plans import summaries as S
from orderscope.sources.tables import Tables


@contextmanager
def geography(t: Tables, top_nations: int = D.TOP_NATIONS) -> Iterator[dict[str, DataFrame]]:
    """Q06, D1, D2 and D3 from one aggregation of the orders.

    Yields ``revenue_by_region``, ``regional_summary``, ``top_nations`` and
    ``region_hierarchy``, each equal to its stand-alone function."""
    scale = t.amount("orders", "o_totalprice").scale
    base = S.region_nation_totals(t).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        regions = S.region_view(base, scale)
        yield {"revenue_by_region": regions, "regional_summary": D.regional_view(base, scale),
               "top_nations": D.top_nations_view(regions, top_nations),
               "region_hierarchy": D.hierarchy_view(base, scale)}
    finally:
        base.unpersist()


@contextmanager
def segments(t: Tables) -> Iterator[dict[str, DataFrame]]:
    """Q07 and D5 from one aggregation of customers and their orders."""
    scale = t.amount("orders", "o_totalprice").scale
    base = S.segment_totals(t).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield {"market_segment_analysis": S.segment_view(base, scale),
               "segment_revenue_share": D.segment_share_view(base, scale)}
    finally:
        base.unpersist()


@contextmanager
def overview(t: Tables) -> Iterator[dict[str, DataFrame]]:
    """Q01–Q04, Q13, D4 and D7 from two scans of the orders instead of five.

    Scan one builds a cube of additive measures by (status, priority,
    month) — combined map-side, at most statuses × priorities × months
    rows — and persists it; the breakdowns and all sums come from it.
    Scan two counts distinct customers per month and overall in one
    ``rollup``; that needs the customer key, so it cannot come from the
    cube. Each view equals its stand-alone function."""
    scale = t.amount("orders", "o_totalprice").scale
    month = month_start("o_orderdate")
    cube = S.order_totals(t, status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"),
                          order_month=month).persist(StorageLevel.MEMORY_AND_DISK)
    customers = (t.orders.rollup(month.alias("order_month"))
                 .agg(F.count_distinct("o_custkey").alias("customers"), F.grouping_id().alias("level"))
                 .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        def by(*keys: str) -> DataFrame:
            return cube.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("orders", "value", "priced")))

        months, statuses = by("order_month"), by("status")
        per_month = customers.filter("level = 0").select(F.col("order_month").alias("_month"), "customers")
        with_customers = months.join(per_month, months["order_month"].eqNullSafe(per_month["_month"]))
        # Two one-row results become one row by a union and an aggregate (no
        # cross join).
        one = by().unionByName(customers.filter("level = 1").select("customers"), allowMissingColumns=True).agg(
            *(F.max(c).alias(c) for c in ("orders", "value", "priced", "customers")))
        kpis = S.kpi_view(one, scale)
        yield {"kpi_metrics": kpis, "orders_summary": S.summary_view(with_customers, scale),
               "orders_by_status": S.status_view(statuses, scale),
               "orders_by_priority": S.priority_view(by("priority"), scale),
               "monthly_revenue": S.month_view(months, scale),
               "status_share": D.status_share_view(statuses, scale),
               "kpi_cards": D.kpi_cards_from(kpis)}
    finally:
        cube.unpersist()
        customers.unpersist()
