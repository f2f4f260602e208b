"""Numeric coercion of text columns.

A string column becomes double when at least one of its values parses as a
number; its unparsable values then become NULL. A column where nothing
parses (or that is empty) is left as it is. Non-string columns are never
touched.

Deciding the output schema needs one look at the data. A caller who knows
which columns hold numbers names them, and nothing runs. Otherwise the
function is *eager*: one aggregation over all string columns at once (partial
aggregates combined map-side, one small row back to the driver holding one
flag per column); :func:`coerced` persists the input over that pass and the
result, so that it is computed once.

Accepted text: optional spaces, optional sign, digits with an optional
decimal point and exponent, or ``inf``/``infinity``. ``nan`` does not count
as a number, and neither does a type suffix such as ``1d`` or ``2f``,
which Spark's own cast would accept, nor a literal beyond the double range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The number syntax accepted, and the spelled-out infinities
# within it (both case-insensitive).
NUMBER_PATTERN = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)\s*$"
INFINITY_PATTERN = r"(?i)^\s*[+-]?(inf|infinity)\s*$"


def parse_number(c: str | Column) -> Column:
    """The text as double, or NULL when it is not a number by the rule above.
    Only the words ``inf``/``infinity`` give an infinite value; a literal too
    large for a double (``1e400``) is not a number."""
    col = F.col(c) if isinstance(c, str) else c
    value = col.try_cast("double")
    finite_or_named = col.rlike(INFINITY_PATTERN) | (F.abs(value) != F.lit(float("inf")))
    return F.when(col.rlike(NUMBER_PATTERN) & finite_or_named, value)


def coerce_numeric(df: DataFrame, numeric: Iterable[str] | None = None) -> DataFrame:
    """Convert every string column that holds at least one number to double,
    or, with ``numeric``, the string columns named there (lazy). Without it
    the input runs once here and once more in the result; :func:`coerced`
    avoids the second run."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if numeric is not None:
        convert = set(numeric) & set(names)
    elif names:
        flags = df.agg(*[F.max(parse_number(F.col(n)).isNotNull()).alias(f"_{i}")
                         for i, n in enumerate(names)]).first()
        convert = {n for i, n in enumerate(names) if flags[f"_{i}"]}
    else:
        return df
    return df.select(*[
        parse_number(F.col(f.name)).alias(f.name) if f.name in convert else F.col(f.name)
        for f in df.schema.fields
    ])


@contextmanager
def coerced(df: DataFrame) -> Iterator[DataFrame]:
    """:func:`coerce_numeric` with the input persisted over both its passes and
    released on exit."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield coerce_numeric(kept)
    finally:
        kept.unpersist()
