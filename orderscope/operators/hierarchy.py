"""Two-level totals for a hierarchy (D3) and roll-ups of aggregates.

``rollup`` produces the leaf rows, the per-parent subtotals and a grand
total in one aggregation. ``grouping_id`` — not a NULL test, since a key can
itself be NULL — tells the levels apart; the grand total is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hierarchy_totals(df: DataFrame, parent: str, child: str, *measures: Column) -> DataFrame:
    """Rows for each (parent) and each (parent, child), with a ``depth`` column
    (1 for parent subtotals, 2 for leaves). ``measures`` are aggregate columns."""
    gid = F.grouping_id(parent, child)
    return (
        df.rollup(parent, child)
        .agg(*measures, gid.alias("_gid"))
        .filter(F.col("_gid") < 3)
        .withColumn("depth", F.when(F.col("_gid") == 0, 2).otherwise(1))
        .drop("_gid")
    )
