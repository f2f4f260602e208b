"""The sinks as queries: what they wrote, read back.

Snapshots (S4), CSV exports (S3) and write reports (S6) have effects; each
query here has the effect in a fresh folder of the session's shared storage and
returns what another reader finds there. All three run jobs while they are
called: what they show is what a write left behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderscope.functions.dates import month_start
from orderscope.plans import summaries as S
from orderscope.session import ensure_checkpoint_dir
from orderscope.sinks.csv_export import CSV_OPTIONS, export_csv, measure
from orderscope.sinks.snapshot import SnapshotStore
from orderscope.sources.tables import Tables

SNAPSHOT_REGION = "region_totals"


def _fresh(t: Tables, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def snapshot_round_trip(t: Tables) -> DataFrame:
    """Q06 asked for three times in a new snapshot store: built, reused, and
    built anew on demand. The rows of the newest build, with the number of
    the build that each request got and whether a build keeps its row order."""
    store = SnapshotStore(t.spark, _fresh(t, "snapshots"))
    source, params = t.source or "tables", {"measure": "o_totalprice"}
    built: list = []
    for refresh in (False, False, True):
        store.get_or_build(SNAPSHOT_REGION, lambda: S.revenue_by_region(t), source, params, refresh)
        path = store.latest_build(SNAPSHOT_REGION, source, params).path
        if path not in built:
            built.append(path)
    return store.read(SNAPSHOT_REGION, source, params).select(
        "region", "nation", "order_count", "total_revenue", F.lit(len(built)).cast("long").alias("builds"))


def odd_text_orders(t: Tables) -> DataFrame:
    """Orders with texts that CSV must quote, blanks, nulls and microseconds."""
    key = F.col("o_orderkey")
    text = (F.when(key % 5 == 0, F.concat(F.lit('say "'), "o_orderpriority", F.lit('", then go')))
            .when(key % 5 == 1, F.concat(F.lit("  "), "o_orderpriority", F.lit("  ")))
            .when(key % 5 == 2, F.lit(None).cast("string"))
            .when(key % 5 == 3, F.lit(""))
            .otherwise(F.concat("o_orderstatus", F.lit("\n"), "o_orderpriority")))
    return t.orders.select(
        "o_orderkey", text.alias("note"), "o_totalprice", (key % 3 == 0).alias("is_third"),
        (F.col("o_orderdate").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((key % 4) / 1000000).cast("decimal(18,6)"))).alias("placed"),
        F.to_date("o_orderdate").alias("day"))


def csv_round_trip(t: Tables) -> DataFrame:
    """S3: the orders with odd texts exported and read back as text, field by
    field; an empty field is null."""
    path = _fresh(t, "csv")
    data = odd_text_orders(t)
    export_csv(data, path)
    schema = ", ".join(f"{c} string" for c in data.columns)
    rows = t.spark.read.options(**CSV_OPTIONS, multiLine="true").schema(schema).csv(path)
    return rows.select(F.col("o_orderkey").cast("long").alias("o_orderkey"),
                       *(F.when(F.col(c) != "", F.col(c)).alias(c) for c in data.columns[1:]))


def write_reports(t: Tables) -> DataFrame:
    """Rows of several results as their writes counted them, and whether
    the report has a time. Each result is computed once."""
    results = {"orders": t.orders, "orders_summary": S.orders_summary(t), "order_months": t.orders.select(
        month_start("o_orderdate").alias("m")).distinct(), "large_orders": t.orders.filter("o_totalprice > 300000"),
        "no_orders": t.orders.filter("o_orderkey < 0")}
    reports = [(name, report.rows, report.seconds > 0) for name, df in results.items() for report in [measure(df)]]
    return t.spark.createDataFrame(reports, "result string, rows_written long, timed boolean")
