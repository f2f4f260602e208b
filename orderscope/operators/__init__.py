"""Reusable DataFrame operators."""

from orderscope.operators.hierarchy import hierarchy_totals
from orderscope.operators.punctuality import shipping_punctuality, with_on_time_rate
from orderscope.operators.shares import share_of_total
from orderscope.operators.topk import check_limit, top_k, total_order

__all__ = ["check_limit", "hierarchy_totals", "share_of_total", "shipping_punctuality",
           "top_k", "total_order", "with_on_time_rate"]
