"""Physical-plan checks: pruning, top-k, no Python in plans, pre-aggregation."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from orderscope.plans import derived as D
from orderscope.plans import summaries as S
from orderscope.plans.registry import QUERIES


def plan_text(df, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_any_plan(sf001, name):
    text = plan_text(QUERIES[name](sf001))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|PythonUDF|FlatMapGroupsInPandas", text)


@pytest.mark.parametrize("name", ["top_customers", "top_parts_by_revenue", "supplier_performance",
                                  "top_customers_by_order_count", "part_sales_by_type", "preview",
                                  "top_nations"])
def test_top_k_has_no_global_sort(sf001, name):
    text = plan_text(QUERIES[name](sf001))
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


def test_scan_reads_only_used_columns(sf001):
    text = plan_text(S.kpi_metrics(sf001))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    assert schemas == ["struct<o_custkey:bigint,o_totalprice:double>"]


def test_lineitem_scan_is_pruned_for_part_revenue(sf001):
    text = plan_text(S.top_parts_by_revenue(sf001))
    li = [s for s in re.findall(r"ReadSchema: (struct<[^>]*>)", text) if "l_" in s]
    assert li == ["struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double>"]


def test_orders_aggregated_below_the_customer_join(sf001):
    # The first aggregate over the orders scan is keyed on o_custkey and comes
    # before any join; the join then sees one row per customer.
    text = plan_text(S.revenue_by_region(sf001))
    body = text.split("\n\n")
    first_agg = next(b for b in body if b.startswith("(") and "HashAggregate" in b.splitlines()[0])
    assert "Keys [1]: [o_custkey" in first_agg


def test_money_sums_are_long_limbs(sf001):
    text = plan_text(S.orders_by_status(sf001))
    assert "partial_sum(shiftright(" in text
    assert "partial_sum(cast(" not in text


def test_status_share_ends_in_its_sort(sf001):
    body = plan_text(D.status_share(sf001), "simple")
    operators = re.findall(r"(Sort|Window) \[", body)
    assert operators and operators[0] == "Sort"


def test_supplier_names_stay_out_of_the_distinct(sf001):
    text = plan_text(S.supplier_performance(sf001))
    keyed = [b for b in text.split("\n\n") if "HashAggregate" in b.split("\n")[0] and "l_orderkey" in b]
    assert keyed and not any("s_name" in b.split("Functions")[0] for b in keyed)


def test_preview_reads_wide_rows_up_to_the_last_key_only(sf001):
    text = plan_text(S.orders_preview(sf001))
    assert re.search(r"PushedFilters: \[[^]]*LessThanOrEqual\(o_orderkey", text)


def test_coerced_query_has_one_star_join(sf001):
    text = plan_text(QUERIES["revenue_by_region_coerced"](sf001))
    orders = [s for s in re.findall(r"ReadSchema: (struct<[^>]*>)", text) if "o_custkey" in s]
    assert len(orders) == 1
