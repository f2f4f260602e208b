"""Deterministic top-k.

``ORDER BY measure DESC LIMIT n`` alone cuts through ties arbitrarily, so
the result changes with partitioning. Here every group column is appended
ascending after the measures, which makes the order total whenever the
tie columns identify a row.

Spark plans ``orderBy(...).limit(n)`` as ``TakeOrderedAndProject``: each
partition keeps its own best ``n`` and only ``n × partitions`` rows meet at
the end — no global sort, no shuffle of the input. Memory is bounded by
``n``, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_limit(n: object) -> int:
    """A limit must be a positive integer (it is never pasted into SQL text)."""
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValueError(f"limit must be a positive integer, got {n!r}")
    return n


def total_order(by_desc: Sequence[str | Column], ties: Sequence[str]) -> list[Column]:
    """Sort keys: measures descending, then tie columns ascending; NULLs last."""
    keys = [F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in by_desc]
    keys += [F.col(c).asc_nulls_last() for c in ties]
    return keys


def top_k(df: DataFrame, n: int, by_desc: Sequence[str | Column], ties: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by ``by_desc`` (descending) with ``ties`` ascending."""
    return df.orderBy(*total_order(by_desc, ties)).limit(check_limit(n))
