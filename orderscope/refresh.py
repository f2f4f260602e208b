"""Keep every summary fresh in a snapshot store (the dashboard's cache, as a job).

The dashboard cached each summary for an hour and rebuilt it on demand.
``refresh_summaries`` does the same for a whole set of summaries: each one
is read from the :class:`~orderscope.sinks.snapshot.SnapshotStore` if its
newest build is younger than the store's maximum age, and rebuilt (one
Spark job per summary, written by the executors) otherwise or when
``force`` is set. Run it on a schedule, or from the command line::

    python -m orderscope.refresh --source /data/tpch [--catalog] \\
        [--root /shared/snapshots] [--max-age 3600] [--force] [--only a,b] \\
        [--top top_customers=25]

The snapshot root defaults to a folder under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from orderscope.plans.registry import QUERIES
from orderscope.sinks.snapshot import DEFAULT_MAX_AGE_SECONDS, SnapshotStore
from orderscope.sources.tables import Tables, load_tables

# Registered names that are not summaries to cache: the ad-hoc query and
# the source check (which must always look at the tables as they are now).
NOT_CACHED = ("adhoc_sql", "source_check")


def refresh_summaries(tables: Tables, store: SnapshotStore, force: bool = False,
                      names: Iterable[str] | None = None,
                      plans: dict[str, Callable[..., DataFrame]] | None = None,
                      arguments: Mapping[str, Mapping[str, object]] | None = None
                      ) -> dict[str, DataFrame]:
    """Each summary from the store (rebuilt when stale or forced).

    ``arguments`` are keyword arguments by summary, such as ``{"top_customers":
    {"n": 25}}``; they and the tables' ``source`` are part of what a snapshot
    is kept under."""
    if tables.source is None:
        raise ValueError("tables without a source id cannot be kept in a snapshot store")
    plans = plans or QUERIES
    arguments = arguments or {}
    wanted = list(names) if names is not None else [n for n in plans if n not in NOT_CACHED]

    def one(name: str) -> DataFrame:
        args = dict(arguments.get(name, {}))
        return store.get_or_build(name, lambda: plans[name](tables, **args), tables.source, args, refresh=force)
    return {name: one(name) for name in wanted}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--source", required=True, help="parquet folder, or namespace with --catalog")
    parser.add_argument("--catalog", action="store_true")
    parser.add_argument("--root", default=None, help="snapshot root (default: under spark.checkpoint.dir)")
    parser.add_argument("--max-age", type=float, default=DEFAULT_MAX_AGE_SECONDS)
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--only", default="", help="comma-separated summary names")
    parser.add_argument("--top", default="", help="comma-separated name=n: the list size of top-N summaries")
    args = parser.parse_args(argv)

    # No web UI for a batch job; stage times go to the event log if wanted.
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tables = load_tables(spark, args.source, catalog=args.catalog)
    store = SnapshotStore(spark, args.root, args.max_age)
    names = [n for n in args.only.split(",") if n] or None
    start = time.perf_counter()
    top = {name: {"n": int(n)} for name, n in (item.split("=") for item in args.top.split(",") if item)}
    snapshots = refresh_summaries(tables, store, args.force, names, arguments=top)
    print(json.dumps({"root": store.root, "summaries": sorted(snapshots),
                      "seconds": round(time.perf_counter() - start, 3)}))


if __name__ == "__main__":
    main()
