"""Column expressions: money, calendar, display formats, numeric coercion."""

from orderscope.functions.coerce import coerce_numeric, coerced, parse_number
from orderscope.functions.dates import days_between, month_start
from orderscope.functions.display import dollars, humanize_currency, humanize_number, whole_number
from orderscope.functions.money import (
    Amount,
    amount,
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

__all__ = [
    "Amount",
    "amount",
    "coerce_numeric",
    "coerced",
    "days_between",
    "dollars",
    "humanize_currency",
    "humanize_number",
    "merge_split",
    "month_start",
    "net_amount",
    "parse_number",
    "split_mean",
    "split_parts",
    "split_sum",
    "split_total",
    "split_value",
    "units_mean",
    "units_value",
    "whole_number",
]
