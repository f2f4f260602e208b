"""Shipping punctuality per class (Q11), generic in its columns.

For each value of ``mode`` over the rows of ``df``:

* ``shipment_count`` — all rows, whatever their dates;
* ``avg_days_to_ship`` — mean of (ship − commit) in days; negative is early,
  rows with a NULL date are skipped, NULL when no row has both dates;
* ``on_time_count`` — ship at or before commit, by the columns' own order;
* ``late_count`` — ship after commit (a later hour of the same day is late).

A row with a NULL date counts in neither of the last two, so
``on_time + late`` may be below ``shipment_count``. Counts use
``sum(when(..., 1).otherwise(0))``, which is 0 (not NULL) for a class
whose dates are all NULL.

This is one aggregation: partial counts and sums are combined map-side
before the shuffle, so a class holding most rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderscope.functions.dates import days_between


def shipping_punctuality(df: DataFrame, mode: str, ship: str, commit: str) -> DataFrame:
    days = days_between(ship, commit)
    on_time = F.col(ship) <= F.col(commit)
    return (
        df.groupBy(F.col(mode).alias("ship_mode"))
        .agg(
            F.count(F.lit(1)).alias("shipment_count"),
            F.avg(days).alias("avg_days_to_ship"),
            F.sum(F.when(on_time, 1).otherwise(0)).cast("long").alias("on_time_count"),
            F.sum(F.when(~on_time, 1).otherwise(0)).cast("long").alias("late_count"),
        )
    )


def with_on_time_rate(df: DataFrame) -> DataFrame:
    """``on_time / (on_time + late) × 100``; NULL when both are zero."""
    rate = F.try_divide(F.col("on_time_count"), F.col("on_time_count") + F.col("late_count"))
    return df.withColumn("on_time_rate", rate * F.lit(100))
