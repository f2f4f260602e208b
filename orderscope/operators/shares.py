"""Share of total.

Meant for an *already aggregated* frame, one row per category: the window
over the whole frame then sees as many rows as there are categories
(statuses, segments), never the raw data. The total is summed exactly when
the input column is integer or decimal, so shares do not depend on row
order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _to_double(c: Column) -> Column:
    return c.cast("double")


def share_of_total(value: str | Column,
                   to_double: Callable[[Column], Column] = _to_double) -> Column:
    """``value / sum(value) over all rows`` as double; NULL when either is NULL
    or the total is zero. The total is summed in the column's own (exact)
    type; ``to_double`` converts value and total before the division."""
    v = F.col(value) if isinstance(value, str) else value
    total = F.sum(v).over(Window.partitionBy())
    return F.try_divide(to_double(v), to_double(total))
