"""Independent SQL for every registered query, for DuckDB.

These are written the *direct* way — join first, aggregate after, as the
dashboard's SQL does — so they also check the aggregate-below-join
rewrites in :mod:`orderscope.plans.summaries`. Money is summed in a cast
wider than the data (``DECIMAL(18,6)``, independent of the library's own
scale) and every top-N has the same tie-break, so results must agree value
for value. Tables are the bare view names.
"""

from __future__ import annotations


def _msum(x: str) -> str:
    return f"SUM(CAST({x} AS DECIMAL(18,6)))"


def _money(x: str) -> str:
    return f"CAST({_msum(x)} AS DOUBLE)"


def _mean(x: str) -> str:
    return f"{_money(x)} / COUNT({x})"


_MONTH = "CAST(DATE_TRUNC('month', {0}) AS DATE)"
_NET = "CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,6)))"

_Q01 = f"""
SELECT COUNT(*) AS total_orders,
       {_money('o_totalprice')} AS total_revenue,
       COUNT(DISTINCT o_custkey) AS total_customers,
       {_mean('o_totalprice')} AS avg_order_value
FROM orders"""

_Q02 = f"""
SELECT {_MONTH.format('o_orderdate')} AS order_month,
       COUNT(*) AS total_orders,
       {_money('o_totalprice')} AS total_revenue,
       {_mean('o_totalprice')} AS avg_order_value,
       COUNT(DISTINCT o_custkey) AS unique_customers
FROM orders
GROUP BY 1
ORDER BY order_month NULLS FIRST"""

_Q03 = f"""
SELECT o_orderstatus AS status, COUNT(*) AS order_count,
       {_money('o_totalprice')} AS total_value
FROM orders
GROUP BY o_orderstatus
ORDER BY order_count DESC, status"""

_Q04 = f"""
SELECT o_orderpriority AS priority, COUNT(*) AS order_count,
       {_money('o_totalprice')} AS total_value,
       {_mean('o_totalprice')} AS avg_value
FROM orders
GROUP BY o_orderpriority
ORDER BY order_count DESC, priority"""

_Q05 = f"""
SELECT c.c_name AS customer_name, c.c_mktsegment AS market_segment, n.n_name AS nation,
       COUNT(o.o_orderkey) AS order_count,
       {_money('o.o_totalprice')} AS total_spent,
       {_mean('o.o_totalprice')} AS avg_order_value
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY c.c_name, c.c_mktsegment, n.n_name
ORDER BY total_spent DESC, customer_name ASC NULLS LAST, market_segment ASC NULLS LAST,
         nation ASC NULLS LAST
LIMIT 10"""

_STAR = """
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey"""

_Q06 = f"""
SELECT r.r_name AS region, n.n_name AS nation,
       COUNT(o.o_orderkey) AS order_count,
       {_money('o.o_totalprice')} AS total_revenue
{_STAR}
GROUP BY r.r_name, n.n_name
ORDER BY total_revenue DESC, region, nation"""

_SEGMENTS = f"""
SELECT c.c_mktsegment AS segment,
       COUNT(DISTINCT c.c_custkey) AS customer_count,
       COUNT(o.o_orderkey) AS order_count,
       {_msum('o.o_totalprice')} AS revenue,
       COUNT(o.o_totalprice) AS priced
FROM customer c
LEFT JOIN orders o ON c.c_custkey = o.o_custkey
GROUP BY c.c_mktsegment"""

_Q07 = f"""
SELECT segment, customer_count, order_count,
       CAST(revenue AS DOUBLE) AS total_revenue,
       CAST(revenue AS DOUBLE) / priced AS avg_order_value
FROM ({_SEGMENTS}) s
ORDER BY total_revenue DESC NULLS LAST, segment"""

_Q08 = f"""
SELECT p.p_name AS part_name, p.p_type AS part_type, p.p_brand AS brand,
       CAST(SUM({_NET}) AS DOUBLE) AS revenue,
       {_money('l.l_quantity')} AS quantity_sold
FROM lineitem l
JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY p.p_name, p.p_type, p.p_brand
ORDER BY revenue DESC, part_name ASC NULLS LAST, part_type ASC NULLS LAST, brand ASC NULLS LAST
LIMIT 10"""

_Q09 = f"""
SELECT s.s_name AS supplier_name, n.n_name AS nation,
       COUNT(DISTINCT l.l_orderkey) AS orders_supplied,
       {_money('l.l_extendedprice')} AS total_supply_value,
       {_mean('l.l_extendedprice')} AS avg_line_value
FROM lineitem l
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY s.s_name, n.n_name
ORDER BY total_supply_value DESC, supplier_name ASC NULLS LAST, nation ASC NULLS LAST
LIMIT 10"""

_Q10 = f"""
SELECT {_MONTH.format('o.o_orderdate')} AS order_month, c.c_mktsegment AS segment,
       {_money('o.o_totalprice')} AS revenue
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY 1, 2
ORDER BY order_month NULLS FIRST, segment NULLS FIRST"""

# Stand-in: class = l_returnflag, commit date = order date + 60 days.
_COMMIT = "CAST(o.o_orderdate AS DATE) + 60"
_DAYS = f"DATE_DIFF('day', {_COMMIT}, CAST(l.l_shipdate AS DATE))"
_Q11 = f"""
SELECT l.l_returnflag AS ship_mode,
       COUNT(*) AS shipment_count,
       AVG({_DAYS}) AS avg_days_to_ship,
       CAST(SUM(CASE WHEN l.l_shipdate <= {_COMMIT} THEN 1 ELSE 0 END) AS BIGINT) AS on_time_count,
       CAST(SUM(CASE WHEN l.l_shipdate > {_COMMIT} THEN 1 ELSE 0 END) AS BIGINT) AS late_count
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY l.l_returnflag
ORDER BY shipment_count DESC, ship_mode"""

_Q12 = """
SELECT c_name, COUNT(*) AS order_count
FROM customer, orders
WHERE c_custkey = o_custkey
GROUP BY c_name
ORDER BY 2 DESC, 1 ASC NULLS LAST
LIMIT 5"""

_Q13 = f"""
SELECT {_MONTH.format('o_orderdate')} AS month, {_money('o_totalprice')} AS revenue
FROM orders GROUP BY 1 ORDER BY 1 NULLS FIRST"""

_Q14 = f"""
SELECT p_type, {_money('l_extendedprice')} AS total_sales
FROM part, lineitem
WHERE p_partkey = l_partkey
GROUP BY p_type
ORDER BY 2 DESC, 1 ASC NULLS LAST
LIMIT 10"""

_Q15 = """
SELECT * FROM orders
ORDER BY o_orderkey ASC NULLS LAST, o_custkey ASC NULLS LAST, o_orderstatus ASC NULLS LAST,
         o_totalprice ASC NULLS LAST, o_orderdate ASC NULLS LAST, o_orderpriority ASC NULLS LAST
LIMIT 10"""

_Q16 = """
WITH big AS (
    SELECT * FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_orderdate >= DATE '1995-01-01')
SELECT o_orderpriority AS priority, COUNT(o_orderkey) AS large_orders, MAX(o_totalprice) AS largest
FROM big GROUP BY ALL"""

_Q17 = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))

_D1 = f"""
SELECT r.r_name AS region,
       COUNT(o.o_orderkey) AS order_count,
       {_money('o.o_totalprice')} AS total_revenue,
       {_money('o.o_totalprice')} / COUNT(o.o_orderkey) AS avg_order_value
{_STAR}
GROUP BY r.r_name
ORDER BY total_revenue DESC, region"""

_D2 = f"""
SELECT * FROM ({_Q06}) q
ORDER BY total_revenue DESC, region ASC NULLS LAST, nation ASC NULLS LAST
LIMIT 10"""

_D3 = f"""
WITH rn AS (
    SELECT r.r_name AS region, n.n_name AS nation, {_msum('o.o_totalprice')} AS revenue
    {_STAR}
    GROUP BY r.r_name, n.n_name)
SELECT region, nation, 2 AS depth, CAST(revenue AS DOUBLE) AS total_revenue FROM rn
UNION ALL
SELECT region, NULL AS nation, 1 AS depth, CAST(SUM(revenue) AS DOUBLE) AS total_revenue
FROM rn GROUP BY region"""

_D4 = f"""
SELECT status, order_count, total_value,
       order_count / SUM(order_count) OVER () AS order_share
FROM ({_Q03}) s
ORDER BY order_count DESC, status"""

_D5 = f"""
SELECT segment, customer_count, order_count,
       CAST(revenue AS DOUBLE) AS total_revenue,
       CAST(revenue AS DOUBLE) / priced AS avg_order_value,
       CAST(revenue AS DOUBLE) / CAST(SUM(revenue) OVER () AS DOUBLE) AS revenue_share
FROM ({_SEGMENTS}) s"""

_D6 = f"""
SELECT *, on_time_count / NULLIF(on_time_count + late_count, 0) * 100 AS on_time_rate
FROM ({_Q11}) f"""


def _human(x: str, prefix: str, small: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL"
            f" WHEN isnan({x}) THEN '{prefix}nan'"
            f" WHEN {x} >= 1e9 THEN '{prefix}' || format('{{:.2f}}', {x} / 1e9) || 'B'"
            f" WHEN {x} >= 1e6 THEN '{prefix}' || format('{{:.2f}}', {x} / 1e6) || 'M'"
            f" WHEN {x} >= 1e3 THEN '{prefix}' || format('{{:.1f}}', {x} / 1e3) || 'K'"
            f" ELSE '{prefix}' || format('{small}', {x}) END")


def _currency(x: str) -> str:
    return _human(f"CAST({x} AS DOUBLE)", "$", "{:.2f}")


def _number(x: str) -> str:
    return _human(f"CAST({x} AS DOUBLE)", "", "{:,.0f}")


_D7 = f"""
WITH k AS ({_Q01})
SELECT 1 AS position, 'Total Orders' AS label, {_number('total_orders')} AS text FROM k
UNION ALL SELECT 2, 'Total Revenue', {_currency('total_revenue')} FROM k
UNION ALL SELECT 3, 'Unique Customers', {_number('total_customers')} FROM k
UNION ALL SELECT 4, 'Avg Order Value', {_currency('avg_order_value')} FROM k"""

_D1_DISPLAY = f"""
SELECT region,
       format('{{:,.0f}}', CAST(order_count AS DOUBLE)) AS order_count,
       '$' || format('{{:,.2f}}', total_revenue) AS total_revenue,
       '$' || format('{{:,.2f}}', avg_order_value) AS avg_order_value
FROM ({_D1}) d"""

_Q06_COERCED = f"""
SELECT region, nation, CAST(order_count AS DOUBLE) AS order_count, total_revenue
FROM ({_Q06}) q"""

_S3 = """
SELECT o_orderkey,
       nullif(CASE o_orderkey % 5
              WHEN 0 THEN 'say "' || o_orderpriority || '", then go'
              WHEN 1 THEN '  ' || o_orderpriority || '  '
              WHEN 2 THEN NULL
              WHEN 3 THEN ''
              ELSE o_orderstatus || chr(10) || o_orderpriority END, '') AS note,
       CAST(o_totalprice AS VARCHAR) AS o_totalprice,
       CASE WHEN o_orderkey % 3 = 0 THEN 'True' ELSE 'False' END AS is_third,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
         || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '.00000' || (o_orderkey % 4) END AS placed,
       strftime(o_orderdate, '%Y-%m-%d') AS day
FROM orders"""

_S4 = f"""
SELECT region, nation, order_count, total_revenue, 2 AS builds FROM ({_Q06}) q"""

_S6 = f"""
SELECT 'orders' AS result, COUNT(*) AS rows_written, TRUE AS timed FROM orders
UNION ALL SELECT 'orders_summary', COUNT(*), TRUE FROM ({_Q02}) q
UNION ALL SELECT 'order_months', COUNT(*), TRUE FROM (SELECT DISTINCT {_MONTH.format('o_orderdate')} FROM orders) m
UNION ALL SELECT 'large_orders', COUNT(*), TRUE FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT 'no_orders', COUNT(*), TRUE FROM orders WHERE o_orderkey < 0"""

ORACLE_SQL: dict[str, str] = {
    "kpi_metrics": _Q01,
    "orders_summary": _Q02,
    "orders_by_status": _Q03,
    "orders_by_priority": _Q04,
    "top_customers": _Q05,
    "revenue_by_region": _Q06,
    "market_segment_analysis": _Q07,
    "top_parts_by_revenue": _Q08,
    "supplier_performance": _Q09,
    "monthly_trend_by_segment": _Q10,
    "order_fulfillment_metrics": _Q11,
    "top_customers_by_order_count": _Q12,
    "monthly_revenue": _Q13,
    "part_sales_by_type": _Q14,
    "preview": _Q15,
    "adhoc_sql": _Q16,
    "source_check": _Q17,
    "regional_summary": _D1,
    "top_nations": _D2,
    "region_hierarchy": _D3,
    "status_share": _D4,
    "segment_revenue_share": _D5,
    "on_time_rate": _D6,
    "kpi_cards": _D7,
    "regional_summary_display": _D1_DISPLAY,
    "revenue_by_region_coerced": _Q06_COERCED,
    "csv_round_trip": _S3,
    "snapshot_round_trip": _S4,
    "write_reports": _S6,
}
