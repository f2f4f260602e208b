"""Sinks: CSV export, summary snapshots, write metrics."""

from orderscope.sinks.csv_export import CSV_OPTIONS, WriteReport, export_csv, measure, write_observed
from orderscope.sinks.snapshot import DEFAULT_MAX_AGE_SECONDS, SnapshotStore

__all__ = ["CSV_OPTIONS", "DEFAULT_MAX_AGE_SECONDS", "SnapshotStore", "WriteReport",
           "export_csv", "measure", "write_observed"]
