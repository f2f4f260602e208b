"""Display formats as column expressions.

These reproduce the dashboard's text formats exactly, including its quirks:
thresholds are inclusive, thousands get one decimal and larger units two,
and negative values never get a unit suffix (there is no ``abs``).

Rounding must match Python's ``format`` (round-half-even on the exact
binary value). Spark's ``format_number`` with a *pattern* string does that;
``format_string('%.2f')`` rounds half-up and is not used. NaN and the
infinities are handled before the thresholds because Spark orders NaN above
every number. NULL in gives NULL out.

Each format is one SQL ``CASE`` expression over a named column, parsed by
Spark in a single call: built from Python ``Column`` operators the same
expression needs some forty driver round-trips (about 0.1 s per column);
as SQL text it needs one. The expression runs JVM-side either way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit thresholds and suffixes, largest first, and the number
# pattern used for each (two decimals for B and M, one for K).
UNITS = (
    ("1e9", "B", "0.00"),
    ("1e6", "M", "0.00"),
    ("1e3", "K", "0.0"),
)


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _fraction(decimals: int) -> str:
    return "." + "0" * decimals if decimals else ""


def _plain(x: str, prefix: str, integer_pattern: str, decimals: int) -> str:
    """``x`` in the pattern, exact like Python also for |x| ≥ 2^53.

    Doubles that large are whole numbers, and Python prints their exact
    value, where ``format_number`` prints the shortest decimal digits and
    pads with zeros. Below 2^63 the value is formatted as a ``BIGINT``."""
    big = f"abs({x}) >= 9007199254740992D AND abs({x}) < 9223372036854775808D"
    return (f"CASE WHEN {big} THEN concat('{prefix}', format_number(CAST({x} AS BIGINT), "
            f"'{integer_pattern}'), '{_fraction(decimals)}') "
            f"ELSE concat('{prefix}', format_number({x}, '{integer_pattern}{_fraction(decimals)}')) END")


def _humanize_sql(name: str, prefix: str, integer_pattern: str, decimals: int) -> str:
    x = f"CAST({_quote(name)} AS DOUBLE)"
    branches = [
        f"WHEN {x} IS NULL THEN NULL",
        f"WHEN isnan({x}) THEN '{prefix}nan'",
        f"WHEN {x} = double('inf') THEN '{prefix}infB'",
        f"WHEN {x} = double('-inf') THEN '{prefix}-inf'",
    ]
    branches += [
        f"WHEN {x} >= {threshold} THEN "
        f"concat('{prefix}', format_number({x} / {threshold}, '{pattern}'), '{suffix}')"
        for threshold, suffix, pattern in UNITS
    ]
    return f"CASE {' '.join(branches)} ELSE {_plain(x, prefix, integer_pattern, decimals)} END"


def humanize_currency(name: str) -> Column:
    """``$1.23B``, ``$4.56M``, ``$7.8K`` or ``$12.34``."""
    return F.expr(_humanize_sql(name, "$", "0", 2))


def humanize_number(name: str) -> Column:
    """``1.23B``, ``4.56M``, ``7.8K`` or ``1,234``-style whole number."""
    return F.expr(_humanize_sql(name, "", "#,##0", 0))


def _grouped_sql(name: str, prefix: str, decimals: int) -> str:
    x = f"CAST({_quote(name)} AS DOUBLE)"
    return (f"CASE WHEN {x} IS NULL THEN NULL"
            f" WHEN isnan({x}) THEN '{prefix}nan'"
            f" WHEN {x} = double('inf') THEN '{prefix}inf'"
            f" WHEN {x} = double('-inf') THEN '{prefix}-inf'"
            f" ELSE {_plain(x, prefix, '#,##0', decimals)} END")


def dollars(name: str) -> Column:
    """``$1,234.50`` — thousands separators, two decimals (F8)."""
    return F.expr(_grouped_sql(name, "$", 2))


def whole_number(name: str) -> Column:
    """``1,235`` — thousands separators, no decimals."""
    return F.expr(_grouped_sql(name, "", 0))
