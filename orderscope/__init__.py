"""orderscope — order-analytics summaries over a seven-table star, on Spark.

Every public function takes a :class:`~orderscope.sources.tables.Tables`
bundle (or a DataFrame) and returns a lazy DataFrame; nothing is
collected until the caller acts, but for what building a plan looks up: file
listings, a bounded row count of lookup tables (``Tables.dimension``) and the
n-th key of a keyed ``preview``. Money is summed exactly (integer units) and
every top-N carries a full tie-break, so results do not depend on how the
data is partitioned.

Layout
------
``sources``    table loading, view registration, column checks, ``source_check``
``functions``  column expressions: money, months, display formats, coercion
``operators``  reusable DataFrame transforms: top-k, shares, roll-ups,
               punctuality counts
``plans``      the named summaries, derived tables, shared-aggregate views
               and ad-hoc SQL
``sinks``      CSV export, summary snapshots, write metrics
"""

from orderscope.sources.tables import Tables, load_tables, register_views

__all__ = ["Tables", "load_tables", "register_views"]
