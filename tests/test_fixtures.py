"""Hand-computed mini-fixtures for what the driver data cannot show."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import DAY, make_tables
from orderscope.functions import coerce_numeric, dollars, humanize_currency, humanize_number, whole_number
from orderscope.operators import shipping_punctuality, with_on_time_rate
from orderscope.plans import derived as D
from orderscope.plans import summaries as S


def _order(key, cust, price, date=DAY, status="F", prio="1-URGENT"):
    return (key, cust, status, prio, date, price)


# ---------------------------------------------------------------- M1

@pytest.fixture(scope="module")
def m1(spark):
    return make_tables(
        spark,
        customer=[(1, "c1", 0, "A"), (2, "c2", 0, "A"), (3, "c3", 0, "B")],
        orders=[_order(10, 1, 100.00), _order(11, 1, 50.00), _order(12, 99, 70.00)],
        nation=[(0, "N0", 0)], region=[(0, "R0")])


def test_m1_left_join_keeps_orderless_segment(m1):
    rows = [tuple(r) for r in S.market_segment_analysis(m1).collect()]
    assert rows == [("A", 2, 2, 150.0, 75.0), ("B", 1, 0, None, None)]


def test_m1_kpis_count_orphan_orders(m1):
    row = S.kpi_metrics(m1).first()
    assert (row.total_orders, row.total_revenue, row.total_customers) == (3, 220.0, 2)
    assert math.isclose(row.avg_order_value, 220.0 / 3)


def test_m1_inner_join_drops_orphan(m1):
    rows = S.monthly_trend_by_segment(m1).collect()
    assert sum(r.revenue for r in rows) == 150.0


def test_m1_segment_share_null_for_orderless(m1):
    rows = {r.segment: r.revenue_share for r in D.segment_revenue_share(m1).collect()}
    assert rows == {"A": 1.0, "B": None}


# ---------------------------------------------------------------- M2

@pytest.fixture(scope="module")
def m2(spark):
    return make_tables(
        spark,
        part=[(1, "nut", "X", "b1"), (2, "nut", "X", "b1"), (3, "nut", "X", "b2")],
        lineitem=[(1, 1, 1, 2.0, 100.00, 0.10, DAY), (1, 2, 1, 1.0, 50.00, 0.00, DAY),
                  (1, 3, 1, 4.0, 200.00, 0.50, DAY)])


def test_m2_same_names_merge(m2):
    rows = [tuple(r) for r in S.top_parts_by_revenue(m2).collect()]
    assert rows == [("nut", "X", "b1", 140.0, 3.0), ("nut", "X", "b2", 100.0, 4.0)]


def test_m2_part_type_sales_undiscounted(m2):
    assert [tuple(r) for r in S.part_sales_by_type(m2).collect()] == [("X", 350.0)]


# ---------------------------------------------------------------- M3

def test_m3_punctuality_with_null_dates(spark):
    d = dt.date
    df = spark.createDataFrame(
        [("AIR", d(2020, 1, 5), d(2020, 1, 10)), ("AIR", d(2020, 1, 10), d(2020, 1, 10)),
         ("AIR", d(2020, 1, 12), d(2020, 1, 10)), ("AIR", None, d(2020, 1, 10)),
         ("RAIL", None, None)],
        "l_shipmode string, l_shipdate date, l_commitdate date")
    out = with_on_time_rate(shipping_punctuality(df, "l_shipmode", "l_shipdate", "l_commitdate"))
    rows = {r.ship_mode: r for r in out.collect()}
    air, rail = rows["AIR"], rows["RAIL"]
    assert (air.shipment_count, air.avg_days_to_ship, air.on_time_count, air.late_count) == (4, -1.0, 2, 1)
    assert math.isclose(air.on_time_rate, 200 / 3)
    assert (rail.shipment_count, rail.avg_days_to_ship, rail.on_time_count, rail.late_count,
            rail.on_time_rate) == (1, None, 0, 0, None)


def test_m3_real_columns_through_tables(spark):
    t = make_tables(spark, lineitem=[(1, 1, 1, 1.0, 1.0, 0.0, DAY)])
    li = t.lineitem.withColumn("l_shipmode", F.lit("AIR")).withColumn(
        "l_commitdate", F.to_date(F.lit("2020-01-20")))
    from orderscope.sources.tables import Tables
    t2 = Tables.of(spark, lineitem=li)
    row = S.order_fulfillment_metrics(t2).first()
    assert (row.ship_mode, row.shipment_count, row.avg_days_to_ship, row.on_time_count) == ("AIR", 1, -5.0, 1)


def test_m3_missing_columns_raise(spark):
    from orderscope.sources.tables import MissingColumnsError
    with pytest.raises(MissingColumnsError):
        S.order_fulfillment_metrics(make_tables(spark))


# ---------------------------------------------------------------- M4

@pytest.mark.parametrize("values, expected", [
    (["1", "x", None], [1.0, None, None]),
    ([" 12 ", "1e3", "inf"], [12.0, 1000.0, float("inf")]),
    (["a", "b"], None),
    ([], None),
    (["0x10", "1_000"], None),
    (["1,000", "nan"], None),
    (["1d", ""], None),
    (["1e400", "-1e400", "2", "-INFINITY"], [None, None, 2.0, float("-inf")]),
])
def test_m4_coerce_numeric(spark, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = coerce_numeric(df)
    got = [r.v for r in out.orderBy("i").collect()]
    if expected is None:
        assert dict(out.dtypes)["v"] == "string"
        assert got == values
    else:
        assert dict(out.dtypes)["v"] == "double"
        assert got == expected
    assert dict(out.dtypes)["i"] == "int"


# ---------------------------------------------------------------- M5

M5 = [
    (0.0, "$0.00", "0"),
    (0.125, "$0.12", "0"),
    (999.99, "$999.99", "1,000"),
    (999.995, "$1000.00", "1,000"),
    (1000.0, "$1.0K", "1.0K"),
    (1250.0, "$1.2K", "1.2K"),
    (999999.0, "$1000.0K", "1000.0K"),
    (1000000.0, "$1.00M", "1.00M"),
    (1000000000.0, "$1.00B", "1.00B"),
    (1.5e12, "$1500.00B", "1500.00B"),
    (-5000.0, "$-5000.00", "-5,000"),
    (float("nan"), "$nan", "nan"),
    (None, None, None),
]


def test_m5_humanized_formats(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(M5)], "i int, v double")
    out = df.select("i", humanize_currency("v").alias("c"), humanize_number("v").alias("n"))
    got = [(r.c, r.n) for r in out.orderBy("i").collect()]
    assert got == [(c, n) for _, c, n in M5]


# Expected texts are written by hand: value, currency, number, dollars, whole.
EDGES = [
    (0.005, "$0.01", "0", "$0.01", "0"),            # just above 0.005 as a double
    (0.015, "$0.01", "0", "$0.01", "0"),            # just below
    (0.025, "$0.03", "0", "$0.03", "0"),
    (1.005, "$1.00", "1", "$1.00", "1"),
    (2.675, "$2.67", "3", "$2.67", "3"),
    (0.5, "$0.50", "0", "$0.50", "0"),              # halves go to the even digit
    (1.5, "$1.50", "2", "$1.50", "2"),
    (2.5, "$2.50", "2", "$2.50", "2"),
    (3.5, "$3.50", "4", "$3.50", "4"),
    (-0.001, "$-0.00", "-0", "$-0.00", "-0"),
    (-1234.5, "$-1234.50", "-1,234", "$-1,234.50", "-1,234"),
    (1049.95, "$1.0K", "1.0K", "$1,049.95", "1,050"),
    (1050.0, "$1.1K", "1.1K", "$1,050.00", "1,050"),
    (999950.0, "$1000.0K", "1000.0K", "$999,950.00", "999,950"),
    (2.0 ** 53, "$9007199.25B", "9007199.25B", "$9,007,199,254,740,992.00", "9,007,199,254,740,992"),
    (2.0 ** 62, "$4611686018.43B", "4611686018.43B", "$4,611,686,018,427,387,904.00",
     "4,611,686,018,427,387,904"),
]


def test_m5_format_edges(spark):
    df = spark.createDataFrame([(i, e[0]) for i, e in enumerate(EDGES)], "i int, v double")
    out = df.select("i", humanize_currency("v").alias("c"), humanize_number("v").alias("n"),
                    dollars("v").alias("d"), whole_number("v").alias("w"))
    for r in out.orderBy("i").collect():
        assert (r.c, r.n, r.d, r.w) == EDGES[r.i][1:], EDGES[r.i][0]


# ---------------------------------------------------------------- M6

@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_m6_ties_broken_by_name(spark, partitions):
    counts = {"a": 3, "b": 2, "c": 2, "d": 2}
    cust = [(i, name, 0, "S") for i, name in enumerate(counts)]
    orders, key = [], 0
    for i, name in enumerate(counts):
        for _ in range(counts[name]):
            orders.append(_order(key, i, 1.0))
            key += 1
    t = make_tables(spark, customer=cust, orders=orders)
    from orderscope.sources.tables import Tables
    shuffled = Tables.of(spark, customer=t.customer.repartition(partitions),
                         orders=t.orders.repartition(partitions))
    rows = [tuple(r) for r in S.top_customers_by_order_count(shuffled, 2).collect()]
    assert rows == [("a", 3), ("b", 2)]


# ---------------------------------------------------------------- M7

@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_m7_month_edges(spark, zone):
    dates = [dt.datetime(2020, 1, 31), dt.datetime(2020, 2, 1), dt.datetime(2020, 2, 29), None]
    t = make_tables(spark, orders=[_order(i, 1, 1.0, d) for i, d in enumerate(dates)])
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(r.order_month, r.total_orders) for r in S.orders_summary(t).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert rows == [(None, 1), (dt.date(2020, 1, 1), 1), (dt.date(2020, 2, 1), 2)]


# ---------------------------------------------------------------- limits, cards

def test_limit_must_be_positive_int(sf001):
    for bad in (0, -1, "10", 2.5, True):
        with pytest.raises(ValueError):
            S.top_customers(sf001, bad)


def test_kpi_cards_order_and_labels(m1):
    rows = [tuple(r) for r in D.kpi_cards(m1).collect()]
    assert rows == [(1, "Total Orders", "3"), (2, "Total Revenue", "$220.00"),
                    (3, "Unique Customers", "2"), (4, "Avg Order Value", "$73.33")]


def test_m7_null_month_sorts_first(spark):
    dates = [dt.datetime(2020, 1, 31), dt.datetime(2020, 2, 1), None]
    t = make_tables(spark, orders=[_order(i, 1, 1.0, d) for i, d in enumerate(dates)])
    assert [r.month for r in S.monthly_revenue(t).collect()] == [None, dt.date(2020, 1, 1), dt.date(2020, 2, 1)]


# ---------------------------------------------------------------- exact split sums

def test_split_sum_is_exact(spark):
    import random
    from decimal import Decimal
    from orderscope.functions.money import merge_split, split_sum, split_value
    rng = random.Random(3)
    edge = [0, 1, -1, (1 << 23) - 1, 1 << 23, -(1 << 23), (1 << 40) + 7, -(1 << 40) - 5]
    rows = [(g, v) for g in range(4) for v in edge + [rng.randint(-10**12, 10**12) for _ in range(500)]]
    df = spark.createDataFrame(rows, "g int, v long")
    per_g = df.groupBy("g").agg(*split_sum(F.col("v"), "s"))
    total = per_g.agg(*merge_split("s")).select(split_value("s", 0).alias("t")).first().t
    got = {r.g: r.t for r in per_g.select("g", split_value("s", 4).alias("t")).collect()}
    for g in range(4):
        exact = sum(v for gg, v in rows if gg == g)
        assert got[g] == float(Decimal(exact) * Decimal("0.0001"))
    assert total == float(sum(v for _, v in rows))


# ---------------------------------------------------------------- punctuality by value

def test_later_the_same_day_is_late(spark):
    rows = [("AIR", dt.datetime(2020, 1, 2, 18), dt.datetime(2020, 1, 2, 9)),
            ("AIR", dt.datetime(2020, 1, 2, 9), dt.datetime(2020, 1, 2, 9)),
            ("AIR", None, dt.datetime(2020, 1, 2, 9))]
    df = spark.createDataFrame(rows, "m string, s timestamp_ntz, c timestamp_ntz")
    row = with_on_time_rate(shipping_punctuality(df, "m", "s", "c")).first()
    assert (row.shipment_count, row.on_time_count, row.late_count, row.on_time_rate) == (3, 1, 1, 50.0)
    assert row.avg_days_to_ship == 0.0


def test_registered_fulfillment_is_always_the_standin(spark):
    from orderscope.plans.registry import QUERIES
    from orderscope.sources.tables import Tables
    base = make_tables(spark, lineitem=[(1, 1, 1, 1.0, 1.0, 0.0, DAY)], orders=[_order(1, 1, 1.0)])
    li = base.lineitem.withColumns({"l_shipmode": F.lit("AIR"), "l_returnflag": F.lit("R"),
                                    "l_commitdate": F.to_date(F.lit("2020-01-14"))})
    t = Tables.of(spark, lineitem=li, orders=base.orders)
    assert QUERIES["order_fulfillment_metrics"](t).first().ship_mode == "R"
    assert QUERIES["on_time_rate"](t).first().ship_mode == "R"


def test_real_columns_match_duckdb(spark, tmp_path):
    import random

    import duckdb
    import pandas as pd
    rng = random.Random(5)
    when = lambda: None if rng.random() < 0.1 else DAY + dt.timedelta(hours=rng.randint(0, 200))
    rows = [(i, 1, 1, 1.0, 1.0, 0.0, when(), rng.choice(["AIR", "RAIL", None]), when()) for i in range(400)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, "
                               "l_extendedprice double, l_discount double, l_shipdate timestamp_ntz, "
                               "l_shipmode string, l_commitdate timestamp_ntz")
    from orderscope.sources.tables import Tables
    got = [tuple(r) for r in S.order_fulfillment_metrics(Tables.of(spark, lineitem=df)).collect()]
    lineitem = pd.DataFrame({"mode": [r[7] for r in rows], "ship": pd.to_datetime([r[6] for r in rows]),
                             "due": pd.to_datetime([r[8] for r in rows])})
    want = duckdb.connect().register("li", lineitem).execute("""
        SELECT mode, count(*), avg(date_diff('day', due::DATE, ship::DATE)),
               count(*) FILTER (ship <= due), count(*) FILTER (ship > due)
        FROM li GROUP BY mode ORDER BY 2 DESC, 1 NULLS LAST""").fetchall()
    assert got == [tuple(w) for w in want]


# ---------------------------------------------------------------- money without loss

def test_discount_finer_than_a_cent(spark):
    t = make_tables(spark, part=[(1, "p", "T", "b")],
                    lineitem=[(i, 1, 1, 0.125, 100.0, 0.075, DAY) for i in range(4)])
    row = S.top_parts_by_revenue(t).first()
    assert (row.revenue, row.quantity_sold) == (370.0, 0.5)


def test_prices_finer_than_a_cent(spark):
    t = make_tables(spark, orders=[_order(i, 1, 0.004) for i in range(1000)])
    row = S.kpi_metrics(t).first()
    assert (row.total_revenue, row.avg_order_value) == (4.0, 0.004)


def test_decimal_and_date_columns(spark):
    from decimal import Decimal
    from orderscope.sources.tables import Tables
    orders = spark.createDataFrame([(1, 1, "F", "x", dt.date(2020, 1, 31), Decimal("1.234567"))] * 1000,
                                   "o_orderkey long, o_custkey long, o_orderstatus string, "
                                   "o_orderpriority string, o_orderdate date, o_totalprice decimal(18,6)")
    t = Tables.of(spark, orders=orders)
    assert S.kpi_metrics(t).first().total_revenue == 1234.567
    assert S.monthly_revenue(t).first() == (dt.date(2020, 1, 1), 1234.567)


@pytest.mark.parametrize("bad", [0.00004, float("nan"), float("inf"), 5e16])
def test_amount_off_the_grid_is_an_error(spark, bad):
    t = make_tables(spark, orders=[_order(1, 1, 10.0), _order(2, 1, bad)])
    with pytest.raises(Exception, match="amount o_totalprice"):
        S.kpi_metrics(t).collect()


def test_stated_scale_takes_finer_values(spark):
    from orderscope.sources.tables import Tables
    base = make_tables(spark, orders=[_order(1, 1, 0.00004), _order(2, 1, 0.00002)])
    t = Tables.of(spark, orders=base.orders, money_scale=6)
    assert S.kpi_metrics(t).first().total_revenue == 0.00006


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_large_totals_do_not_wrap(spark, ansi):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        t = make_tables(spark, orders=[_order(i, 1, 4e11) for i in range(40_000)])
        assert S.kpi_metrics(t).first().total_revenue == 1.6e16
        bad = make_tables(spark, orders=[_order(1, 1, 5e16)] * 3)
        with pytest.raises(Exception, match="within range"):
            S.kpi_metrics(bad).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_suppliers_of_one_name_and_nation_merge(spark):
    t = make_tables(spark, nation=[(0, "N", 0), (1, "M", 0)],
                    supplier=[(7, "s", 0), (3, "s", 0), (4, "s", 1), (5, None, 0)],
                    lineitem=[(1, 1, 7, 1.0, 1.0, 0.0, DAY), (1, 1, 3, 1.0, 2.0, 0.0, DAY),
                              (2, 1, 4, 1.0, 9.0, 0.0, DAY), (3, 1, 5, 1.0, 0.5, 0.0, DAY)])
    assert [tuple(r) for r in S.supplier_performance(t).collect()] == [
        ("s", "M", 1, 9.0, 9.0), ("s", "N", 1, 3.0, 1.5), (None, "N", 1, 0.5, 0.5)]


def test_keyed_preview_is_the_plain_one(spark):
    orders = [_order(k, 1, float(k or 0)) for k in (5, 3, 3, 9, 1, None)]
    df = make_tables(spark, orders=orders).orders
    for n in (1, 2, 3, 5, 6, 9):
        assert S.preview(df, n, key="o_orderkey").collect() == S.preview(df, n).collect()
    assert S.browse(df, 4).count() == 4


def test_coerced_runs_its_input_once(spark):
    from orderscope.functions import coerced
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    df = spark.createDataFrame([("1", "a"), ("x", "b")], "n string, s string").coalesce(1)
    with coerced(df.mapInArrow(count, df.schema)) as out:
        assert [tuple(r) for r in out.collect()] == [(1.0, "a"), (None, "b")]
    assert seen.value == 2
