"""Sources: the star-schema tables and their check."""

from orderscope.sources.tables import (
    REQUIRED_COLUMNS,
    TABLE_NAMES,
    MissingColumnsError,
    Tables,
    load_tables,
    register_views,
    source_check,
)

__all__ = ["REQUIRED_COLUMNS", "TABLE_NAMES", "MissingColumnsError", "Tables",
           "load_tables", "register_views", "source_check"]
