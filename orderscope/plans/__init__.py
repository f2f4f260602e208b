"""Named plans: summaries (Q01–Q15), derived tables (D1–D7), ad-hoc SQL (Q16)."""

from orderscope.plans.oracle import ORACLE_SQL
from orderscope.plans.registry import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
