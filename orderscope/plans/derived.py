"""Derived tables built on the summaries.

The dashboard computed these on the client in pandas or inside its chart
library. Here each extends the summary's lazy plan, so Spark runs the
summary and the derivation as one job, and roll-ups are taken from the
*exact* decimal totals rather than from already-rounded doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderscope.functions.display import dollars, humanize_currency, humanize_number, whole_number
from orderscope.functions.money import units_mean, units_value
from orderscope.operators.hierarchy import hierarchy_totals
from orderscope.operators.punctuality import with_on_time_rate
from orderscope.operators.shares import share_of_total
from orderscope.operators.topk import top_k
from orderscope.plans import summaries as S
from orderscope.sources.tables import Tables

TOP_NATIONS = 10

# The KPI cards in display order — label, source column, format.
KPI_CARDS = (
    ("Total Orders", "total_orders", "number"),
    ("Total Revenue", "total_revenue", "currency"),
    ("Unique Customers", "total_customers", "number"),
    ("Avg Order Value", "avg_order_value", "currency"),
)


def _scale(t: Tables) -> int:
    return t.amount("orders", "o_totalprice").scale


def regional_view(totals: DataFrame, scale: int) -> DataFrame:
    """D1's columns from the (region, nation) totals."""
    agg = totals.groupBy("region").agg(F.sum("order_count").alias("order_count"), F.sum("revenue").alias("_revenue"))
    return S.by_revenue(agg.select("region", "order_count", units_value("_revenue", scale).alias("total_revenue"),
                                   units_mean("_revenue", scale, "order_count").alias("avg_order_value")), "region")


def regional_summary(t: Tables) -> DataFrame:
    """Per region — region, order_count, total_revenue, avg_order_value
    (revenue over orders, a weighted mean); revenue descending."""
    return regional_view(S.region_nation_totals(t), _scale(t))


def top_nations_view(regions: DataFrame, n: int) -> DataFrame:
    """D2 from Q06's rows."""
    return top_k(regions, n, ["total_revenue"], ["region", "nation"])


def top_nations(t: Tables, n: int = TOP_NATIONS) -> DataFrame:
    """The ``n`` (region, nation) rows of Q06 with the largest revenue."""
    return top_nations_view(S.revenue_by_region(t), n)


def hierarchy_view(totals: DataFrame, scale: int) -> DataFrame:
    """D3's rows from the (region, nation) totals."""
    levels = hierarchy_totals(totals, "region", "nation", F.sum("revenue").alias("_revenue"))
    return levels.select("region", "nation", "depth", units_value("_revenue", scale).alias("total_revenue"))


def region_hierarchy(t: Tables) -> DataFrame:
    """D3: region subtotals (depth 1, nation NULL) and nation leaves (depth 2):
    region, nation, depth, total_revenue. No grand total."""
    return hierarchy_view(S.region_nation_totals(t), _scale(t))


def status_share_view(totals: DataFrame, scale: int) -> DataFrame:
    """D4's columns from Q03's totals."""
    return S.status_view(totals, scale, share_of_total("orders").alias("order_share"))


def status_share(t: Tables) -> DataFrame:
    """Status, order_count, total_value, order_share (of all orders); count
    descending."""
    return status_share_view(S.order_totals(t, status=F.col("o_orderstatus")), _scale(t))


def segment_share_view(totals: DataFrame, scale: int) -> DataFrame:
    """D5's columns from Q07's totals."""
    share = share_of_total("revenue", lambda c: units_value(c, scale))
    return S.segment_view(totals, scale, share.alias("revenue_share"))


def segment_revenue_share(t: Tables) -> DataFrame:
    """Q07 plus revenue_share; a segment with no revenue has NULL share."""
    return segment_share_view(S.segment_totals(t), _scale(t))


def on_time_rate(t: Tables) -> DataFrame:
    """Q11 on the stand-in input plus on_time_rate in %. Data with ship
    modes: ``with_on_time_rate(order_fulfillment_metrics(t))``."""
    return with_on_time_rate(S.order_fulfillment_standin(t))


def kpi_cards_from(kpis: DataFrame) -> DataFrame:
    """D7 on a Q01-shaped row: four rows — position, label, text."""
    formats = {"number": humanize_number, "currency": humanize_currency}
    cards = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"),
                 formats[kind](col).alias("text"))
        for i, (label, col, kind) in enumerate(KPI_CARDS, start=1)
    ])
    return kpis.select(F.inline(cards))


def kpi_cards(t: Tables) -> DataFrame:
    """The four headline cards from Q01, formatted for display."""
    return kpi_cards_from(S.kpi_metrics(t))


def regional_summary_display(t: Tables) -> DataFrame:
    """D1 as the dashboard's table shows it: ``$1,234.56`` money and
    ``1,235`` counts (F8, F9), still sorted by revenue."""
    return regional_summary(t).select(
        "region",
        whole_number("order_count").alias("order_count"),
        dollars("total_revenue").alias("total_revenue"),
        dollars("avg_order_value").alias("avg_order_value"),
    )
