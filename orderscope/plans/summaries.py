"""The named summaries (Q01–Q15).

Each function takes a :class:`Tables` bundle and returns a lazy DataFrame
with the exact output columns of the dashboard query it replaces.

Plan shape, chosen for scale
----------------------------
*Aggregate below the join.* Catalyst does not push an aggregate through a
join, so where a summary joins the fact table (orders, line items) to a
dimension only to group by dimension attributes, the fact table is first
aggregated on the join key. Every measure used is additive (counts, exact
sums in limbs), so the per-key partials can be merged again after the
join without changing the result. This

* collapses a hot key — one customer or part holding a third of all rows —
  into one row per map task before the shuffle (map-side combine), so no
  join task receives the hot key's raw rows;
* makes the join one-to-one on the key and shrinks the rows it moves;
* leaves the broadcast decision for customer, part and supplier to Spark:
  such a side is broadcast only when its measured size is below
  ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at run time) and
  sort-merge joined beyond it. The lookup tables nation and region are
  broadcast on our own proven row bound (:meth:`Tables.dimension`), so a
  missing size statistic can never turn them into a sort-merge join that
  hash-partitions a large frame on 25 keys.

Where the pre-aggregate would not pay, the join comes first and the
aggregate right after it combines map-side: Q05, whose groups are single
customers, and Q10, whose (customer, month) pre-aggregate could not share
its partitioning with the customer join (see their docstrings; both were
measured). Distinct counts over a joined attribute (Q09's orders per
supplier name) cannot be merged from per-key partials unless a name has one
key; Q09 does that for those and joins first for the others. AQE's skew-join
split (on by default, and set by ``local_session``) covers a hot join key there.

*Names, not keys.* Groups are on names as in the source queries, so two
entities with the same name merge (Q05, Q08, Q09, Q12).

*Exact money.* See :mod:`orderscope.functions.money`.

*Sort order.* A plain ascending sort keeps Spark SQL's default, NULLs first
(a NULL month leads); descending sorts put NULLs last. The tie-break
columns that this library adds to every top-N sort ascending, NULLs last.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderscope.functions.dates import month_start
from orderscope.functions.money import (
    merge_split,
    net_amount,
    split_mean,
    split_parts,
    split_sum,
    split_total,
    split_value,
    units_mean,
    units_value,
)
from orderscope.operators.punctuality import shipping_punctuality
from orderscope.operators.topk import top_k
from orderscope.sources.tables import MissingColumnsError, Tables

# The default list sizes of the dashboard and its samples.
DEFAULT_TOP_CUSTOMERS = 10
DEFAULT_TOP_PARTS = 10
DEFAULT_TOP_SUPPLIERS = 10
SAMPLE_TOP_CUSTOMERS_BY_COUNT = 5
SAMPLE_TOP_PART_TYPES = 10
PREVIEW_ROWS = 10
# Stand-in for the missing commit date: the order date plus this many days.
STANDIN_COMMIT_DAYS = 60


# --------------------------------------------------------------------------
# Orders alone (Q01–Q04, Q13)
# --------------------------------------------------------------------------

def kpi_view(totals: DataFrame, scale: int) -> DataFrame:
    """Q01's columns from orders, value (units), priced and customers."""
    return totals.select(
        F.coalesce("orders", F.lit(0).cast("long")).alias("total_orders"),
        units_value("value", scale).alias("total_revenue"),
        F.coalesce("customers", F.lit(0).cast("long")).alias("total_customers"),
        units_mean("value", scale, "priced").alias("avg_order_value"),
    )


def kpi_metrics(t: Tables) -> DataFrame:
    """Q01: one row — total_orders, total_revenue, total_customers, avg_order_value.

    Counts every order, including those whose customer is unknown."""
    price = t.amount("orders", "o_totalprice")
    agg = t.orders.agg(
        F.count(F.lit(1)).alias("orders"),
        *split_sum(price, "value"),
        F.count_distinct("o_custkey").alias("customers"),
        F.count(price.present).alias("priced"),
    )
    return kpi_view(agg.withColumn("value", split_total("value", price)), price.scale)


def order_totals(t: Tables, **keys) -> DataFrame:
    """Per group of the orders: orders, value (exact, in units), priced."""
    price = t.amount("orders", "o_totalprice")
    agg = t.orders.groupBy(*(c.alias(name) for name, c in keys.items())).agg(
        F.count(F.lit(1)).alias("orders"), *split_sum(price, "value"),
        F.count(price.present).alias("priced"))
    return agg.withColumn("value", split_total("value", price)).drop(*split_parts("value"))


def summary_view(months: DataFrame, scale: int) -> DataFrame:
    """Q02's columns from order_month, orders, value, priced, customers."""
    return months.select(
        "order_month",
        F.col("orders").alias("total_orders"),
        units_value("value", scale).alias("total_revenue"),
        units_mean("value", scale, "priced").alias("avg_order_value"),
        F.col("customers").alias("unique_customers"),
    ).orderBy(F.col("order_month").asc())


def orders_summary(t: Tables) -> DataFrame:
    """Q02: per calendar month — order_month, total_orders, total_revenue,
    avg_order_value, unique_customers; months ascending."""
    price = t.amount("orders", "o_totalprice")
    agg = t.orders.groupBy(month_start("o_orderdate").alias("order_month")).agg(
        F.count(F.lit(1)).alias("orders"),
        *split_sum(price, "value"),
        F.count(price.present).alias("priced"),
        F.count_distinct("o_custkey").alias("customers"),
    )
    return summary_view(agg.withColumn("value", split_total("value", price)), price.scale)


def status_view(totals: DataFrame, scale: int, *extra: Column) -> DataFrame:
    """Q03's columns (and ``extra`` ones) from status, orders, value. The sort
    comes last, above any window in ``extra``."""
    return totals.select(
        "status", F.col("orders").alias("order_count"),
        units_value("value", scale).alias("total_value"), *extra,
    ).orderBy(F.col("order_count").desc(), F.col("status").asc_nulls_last())


def orders_by_status(t: Tables) -> DataFrame:
    """Q03: per status — status, order_count, total_value; count descending."""
    return status_view(order_totals(t, status=F.col("o_orderstatus")), t.amount("orders", "o_totalprice").scale)


def priority_view(totals: DataFrame, scale: int) -> DataFrame:
    """Q04's columns from priority, orders, value, priced."""
    return totals.select(
        "priority", F.col("orders").alias("order_count"),
        units_value("value", scale).alias("total_value"),
        units_mean("value", scale, "priced").alias("avg_value"),
    ).orderBy(F.col("order_count").desc(), F.col("priority").asc_nulls_last())


def orders_by_priority(t: Tables) -> DataFrame:
    """Q04: per priority — priority, order_count, total_value, avg_value."""
    return priority_view(order_totals(t, priority=F.col("o_orderpriority")),
                         t.amount("orders", "o_totalprice").scale)


def month_view(months: DataFrame, scale: int) -> DataFrame:
    """Q13's columns from order_month, value."""
    return (months.select(F.col("order_month").alias("month"), units_value("value", scale).alias("revenue"))
            .orderBy(F.col("month").asc()))


def monthly_revenue(t: Tables) -> DataFrame:
    """Q13 (sample "monthly revenue"): month, revenue; months ascending.
    The level only — the sample computes no growth rate."""
    return month_view(order_totals(t, order_month=month_start("o_orderdate")),
                      t.amount("orders", "o_totalprice").scale)


def preview(df: DataFrame, n: int = PREVIEW_ROWS, key: str | None = None) -> DataFrame:
    """Q15: the first ``n`` rows of a table, all columns, in a fixed order
    (the key, if given, and then every column ascending), so the same rows
    come back on every run.

    With a ``key`` the n smallest keys are found first, from that column
    alone, as a subquery of the plan (nothing runs before the result is asked
    for); only rows up to the n-th are then read in full, and the parquet
    scan skips row groups beyond it. Rows without a key sort last; they are
    read apart, from row groups that have any. The rows are the same
    without a key, but every column of every row is read."""
    if key is None:
        return top_k(df, n, [], df.columns)
    order = [key, *(c for c in df.columns if c != key)]
    smallest = top_k(df.select(key).filter(F.col(key).isNotNull()), n, [], [key])
    first = df.filter(F.col(key) <= smallest.agg(F.max(key)).scalar())
    without = top_k(df.filter(F.col(key).isNull()), n, [], order)
    return top_k(first.unionByName(without), n, [], order)


def browse(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """Any ``n`` rows, without a sort: reads no more files than it needs."""
    return df.limit(n)


def orders_preview(t: Tables, n: int = PREVIEW_ROWS) -> DataFrame:
    """Q15 on the orders table."""
    return preview(t.orders, n, key="o_orderkey")


# --------------------------------------------------------------------------
# Orders joined to customers (Q05, Q06, Q07, Q10, Q12)
# --------------------------------------------------------------------------

def orders_per_customer(t: Tables) -> DataFrame:
    """Orders aggregated on ``o_custkey``: additive partials that later
    summaries merge after joining the customer. The result is
    hash-partitioned on the customer key, which the customer join reuses.

    ``order_rows`` counts rows (COUNT(*)), ``order_count`` counts order keys
    (COUNT(o_orderkey)), ``priced`` counts prices, ``revenue`` is two limbs."""
    price = t.amount("orders", "o_totalprice")
    return t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("order_rows"),
        F.count("o_orderkey").alias("order_count"),
        F.count(price.present).alias("priced"),
        *split_sum(price, "revenue"),
    )


def _customers(t: Tables, *cols: str) -> DataFrame:
    return t.customer.select("c_custkey", *cols)


def top_customers(t: Tables, n: int = DEFAULT_TOP_CUSTOMERS) -> DataFrame:
    """Q05: top ``n`` (customer_name, market_segment, nation) by total spent.

    Joined first, aggregated after: the group is (in practice) one
    customer, so a per-customer pre-aggregate would only add a stage —
    measured slower with and without broadcasts. A hot customer is still
    collapsed map-side by the aggregate that directly follows the join
    (and, under a sort-merge join, split by AQE's skew handling)."""
    orders = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    cust = _customers(t, "c_name", "c_mktsegment", "c_nationkey")
    nation = t.dimension("nation", "n_nationkey", "n_name")
    price = t.amount("orders", "o_totalprice")
    joined = (orders.join(cust, orders["o_custkey"] == cust["c_custkey"])
              .join(nation, cust["c_nationkey"] == nation["n_nationkey"]))
    agg = joined.groupBy(
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("market_segment"),
        F.col("n_name").alias("nation"),
    ).agg(
        F.count("o_orderkey").alias("order_count"),
        *split_sum(price, "spent"),
        F.count(price.present).alias("_priced"),
    )
    out = agg.select(
        "customer_name", "market_segment", "nation", "order_count",
        split_value("spent", price).alias("total_spent"),
        split_mean("spent", price, "_priced").alias("avg_order_value"),
    )
    return top_k(out, n, ["total_spent"], ["customer_name", "market_segment", "nation"])


def region_nation_totals(t: Tables) -> DataFrame:
    """Exact per-(region, nation) totals: region, nation, order_count,
    revenue (decimal, in units). Shared by Q06 and the geography tables D1–D3.

    Orders are merged per customer before the customer join; nation and
    region are then joined to one row per customer, and the name groups
    are aggregated map-side before the last (tiny) shuffle."""
    per = orders_per_customer(t)
    cust = _customers(t, "c_nationkey")
    nation = t.dimension("nation", "n_nationkey", "n_name", "n_regionkey")
    region = t.dimension("region", "r_regionkey", "r_name")
    joined = (per.join(cust, per["o_custkey"] == cust["c_custkey"])
              .join(nation, cust["c_nationkey"] == nation["n_nationkey"])
              .join(region, nation["n_regionkey"] == region["r_regionkey"]))
    return joined.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(
        F.sum("order_count").alias("order_count"), *merge_split("revenue"),
    ).select("region", "nation", "order_count", split_total("revenue", t.amount("orders", "o_totalprice")).alias("revenue"))


def by_revenue(df: DataFrame, *ties: str) -> DataFrame:
    """Revenue descending, then the names."""
    return df.orderBy(F.col("total_revenue").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ties))


def region_view(totals: DataFrame, scale: int) -> DataFrame:
    """Q06's columns from :func:`region_nation_totals`."""
    return by_revenue(totals.select("region", "nation", "order_count",
                                    units_value("revenue", scale).alias("total_revenue")), "region", "nation")


def revenue_by_region(t: Tables) -> DataFrame:
    """Q06: region, nation, order_count, total_revenue; revenue descending."""
    return region_view(region_nation_totals(t), t.amount("orders", "o_totalprice").scale)


def segment_totals(t: Tables) -> DataFrame:
    """Exact per-segment totals with customers kept even without orders
    (a LEFT join's rows): segment, customer_count, order_count, revenue (decimal,
    NULL for a segment with no orders), priced.

    Every customer counts, so the distinct count needs the customer table
    alone; orders are merged per customer before they meet it. The two halves
    have one row per segment when they are joined."""
    price = t.amount("orders", "o_totalprice")
    per = orders_per_customer(t)
    cust = _customers(t, "c_mktsegment")
    customers = cust.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count_distinct("c_custkey").alias("customer_count"))
    totals = (per.join(cust, per["o_custkey"] == cust["c_custkey"])
              .groupBy(F.col("c_mktsegment").alias("_segment")).agg(
                  F.sum("order_count").alias("order_count"), *merge_split("revenue"), F.sum("priced").alias("priced")))
    return (customers.join(totals, customers["segment"].eqNullSafe(totals["_segment"]), "left")
            .select("segment", "customer_count", F.coalesce("order_count", F.lit(0).cast("long")).alias("order_count"),
                    split_total("revenue", price).alias("revenue"), "priced"))


def segment_view(totals: DataFrame, scale: int, *extra: Column) -> DataFrame:
    """Q07's columns (and ``extra`` ones) from :func:`segment_totals`."""
    return by_revenue(totals.select(
        "segment", "customer_count", "order_count",
        units_value("revenue", scale).alias("total_revenue"),
        units_mean("revenue", scale, "priced").alias("avg_order_value"), *extra), "segment")


def market_segment_analysis(t: Tables) -> DataFrame:
    """Q07: segment, customer_count, order_count, total_revenue,
    avg_order_value; revenue descending, order-less segments last."""
    return segment_view(segment_totals(t), t.amount("orders", "o_totalprice").scale)


def monthly_trend_by_segment(t: Tables) -> DataFrame:
    """Q10: order_month, segment, revenue; month then segment ascending.

    Joined first, aggregated after. A pre-aggregate on (customer, month)
    would be hash-partitioned on both keys, which the customer join (on the
    customer key alone) cannot reuse, so the orders would be shuffled twice
    (measured: 4 exchanges against 3, and slower with or without
    broadcasts). Joined directly, the orders are shuffled once on the
    customer key, where AQE's skew join splits a hot customer, or not at all
    when the customer side is broadcast; the (month, segment) aggregate is
    then combined map-side before its small shuffle."""
    orders = t.orders.select("o_custkey", month_start("o_orderdate").alias("order_month"),
                             "o_totalprice")
    cust = _customers(t, "c_mktsegment")
    joined = orders.join(cust, orders["o_custkey"] == cust["c_custkey"])
    price = t.amount("orders", "o_totalprice")
    agg = joined.groupBy("order_month", F.col("c_mktsegment").alias("segment")).agg(
        *split_sum(price, "revenue"))
    return (agg.select("order_month", "segment", split_value("revenue", price).alias("revenue"))
            .orderBy(F.col("order_month").asc(), F.col("segment").asc()))


def top_customers_by_order_count(t: Tables, n: int = SAMPLE_TOP_CUSTOMERS_BY_COUNT) -> DataFrame:
    """Q12 (sample): c_name, order_count for the ``n`` names with most orders."""
    per = orders_per_customer(t)
    cust = _customers(t, "c_name")
    agg = (per.join(cust, per["o_custkey"] == cust["c_custkey"])
           .groupBy("c_name").agg(F.sum("order_rows").alias("order_count")))
    return top_k(agg, n, ["order_count"], ["c_name"])


# --------------------------------------------------------------------------
# Line items (Q08, Q09, Q11, Q14)
# --------------------------------------------------------------------------

def top_parts_by_revenue(t: Tables, n: int = DEFAULT_TOP_PARTS) -> DataFrame:
    """Q08: top ``n`` (part_name, part_type, brand) by discounted revenue,
    with quantity_sold. Parts sharing all three names are merged."""
    net = net_amount(t.amount("lineitem", "l_extendedprice"), t.amount("lineitem", "l_discount"))
    quantity = t.amount("lineitem", "l_quantity")
    per = t.lineitem.groupBy("l_partkey").agg(
        *split_sum(net, "net"), *split_sum(quantity, "qty"))
    part = t.part.select("p_partkey", "p_name", "p_type", "p_brand")
    agg = (per.join(part, per["l_partkey"] == part["p_partkey"])
           .groupBy(F.col("p_name").alias("part_name"), F.col("p_type").alias("part_type"),
                    F.col("p_brand").alias("brand"))
           .agg(*merge_split("net"), *merge_split("qty")))
    out = agg.select("part_name", "part_type", "brand", split_value("net", net).alias("revenue"),
                     split_value("qty", quantity).alias("quantity_sold"))
    return top_k(out, n, ["revenue"], ["part_name", "part_type", "brand"])


def _named_suppliers(t: Tables) -> DataFrame:
    nation = t.dimension("nation", "n_nationkey", "n_name")
    return (t.supplier.select("s_suppkey", "s_name", "s_nationkey")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name"))


def _repeated(df: DataFrame, *columns: str) -> DataFrame:
    """Values of ``columns`` that more than one row has, as ``_0, _1, ...``."""
    return (df.groupBy(*(F.col(c).alias(f"_{i}") for i, c in enumerate(columns)))
            .agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"))


def _in(df: DataFrame, values: DataFrame, how: str, *columns: str) -> DataFrame:
    same = reduce(and_, (df[c].eqNullSafe(values[f"_{i}"]) for i, c in enumerate(columns)))
    return df.join(values, same, how)


def supplier_performance(t: Tables, n: int = DEFAULT_TOP_SUPPLIERS) -> DataFrame:
    """Q09: top ``n`` (supplier_name, nation) by undiscounted supply value,
    with orders_supplied (distinct orders) and avg_line_value.

    A group with one supplier counts its orders by the supplier key: line
    items go through one large shuffle, on (supplier, order), so a supplier
    with a third of all lines is spread, and names come to the finished rows.
    Only where suppliers share a group (or a key) their own line items are
    joined first and counted by the names. Whether there are any is asked
    once per bundle (eager: one small job over the supplier table)."""
    price = t.amount("lineitem", "l_extendedprice")
    named = _named_suppliers(t)
    groups, keys = _repeated(named, "s_name", "n_name"), _repeated(named, "s_suppkey")
    li = t.lineitem.select("l_suppkey", "l_orderkey", "l_extendedprice")
    measures = [F.count_distinct("l_orderkey").alias("orders_supplied"), *split_sum(price, "value"),
                F.count(price.present).alias("_lines")]
    shared = t.once("shared suppliers", lambda: bool(groups.select("_rows").unionByName(keys.select("_rows")).take(1)))
    own = _in(_in(named, groups, "left_anti", "s_name", "n_name"), keys, "left_anti", "s_suppkey") if shared else named
    per = li.groupBy("l_suppkey").agg(*measures)
    agg = per.join(own, per["l_suppkey"] == own["s_suppkey"]).select(
        "s_name", "n_name", "orders_supplied", *split_parts("value"), "_lines")
    if shared:
        # Groups of several rows, and all groups of a key that has several.
        theirs = _in(named, groups, "left_semi", "s_name", "n_name").unionByName(
            _in(_in(named, groups, "left_anti", "s_name", "n_name"), keys, "left_semi", "s_suppkey"))
        agg = agg.unionByName(li.join(theirs, li["l_suppkey"] == theirs["s_suppkey"])
                              .groupBy("s_name", "n_name").agg(*measures))
    out = agg.select(
        F.col("s_name").alias("supplier_name"), F.col("n_name").alias("nation"), "orders_supplied",
        split_value("value", price).alias("total_supply_value"),
        split_mean("value", price, "_lines").alias("avg_line_value"))
    return top_k(out, n, ["total_supply_value"], ["supplier_name", "nation"])


def part_sales_by_type(t: Tables, n: int = SAMPLE_TOP_PART_TYPES) -> DataFrame:
    """Q14 (sample): p_type, total_sales (undiscounted) for the top ``n`` types."""
    price = t.amount("lineitem", "l_extendedprice")
    per = t.lineitem.groupBy("l_partkey").agg(*split_sum(price, "sales"))
    part = t.part.select("p_partkey", "p_type")
    agg = (per.join(part, per["l_partkey"] == part["p_partkey"])
           .groupBy("p_type").agg(*merge_split("sales")))
    out = agg.select("p_type", split_value("sales", price).alias("total_sales"))
    return top_k(out, n, ["total_sales"], ["p_type"])


def order_fulfillment_metrics(t: Tables, mode: str = "l_shipmode", ship: str = "l_shipdate",
                              commit: str = "l_commitdate") -> DataFrame:
    """Q11 on line items that carry a ship mode and a commit date:
    ship_mode, shipment_count, avg_days_to_ship, on_time_count, late_count;
    shipments descending."""
    missing = [c for c in (mode, ship, commit) if c not in t.lineitem.columns]
    if missing:
        raise MissingColumnsError(f"table 'lineitem' lacks column(s) {missing}; "
                                  "see order_fulfillment_standin")
    return _by_shipments(shipping_punctuality(t.lineitem, mode, ship, commit))


def fulfillment_standin_input(t: Tables) -> DataFrame:
    """Line items with a stand-in commit date, for data without one.

    Stand-in (stated, not inferred): class = ``l_returnflag``, commit date =
    the order's date + 60 days, joined on ``l_orderkey = o_orderkey``.
    Orders are one row per key; a hot order key on the line-item side is
    split by AQE's skew join."""
    li = t.lineitem.select("l_orderkey", "l_returnflag", "l_shipdate")
    orders = t.orders.select(
        "o_orderkey",
        F.date_add(F.to_date("o_orderdate"), STANDIN_COMMIT_DAYS).alias("commit_date"))
    return li.join(orders, li["l_orderkey"] == orders["o_orderkey"])


def order_fulfillment_standin(t: Tables) -> DataFrame:
    """Q11 on the stand-in input (see :func:`fulfillment_standin_input`)."""
    return _by_shipments(shipping_punctuality(
        fulfillment_standin_input(t), "l_returnflag", "l_shipdate", "commit_date"))


def _by_shipments(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("shipment_count").desc(), F.col("ship_mode").asc_nulls_last())
