"""CSV export of a result (S3) with its row count and elapsed time.

The result is written by the executors as a directory of part files, each
with a header row — it is never gathered into one task or onto the driver,
since an ad-hoc result has no size bound. The text is that of a pandas
``to_csv(index=False)`` export: fields are quoted where needed and quotes
doubled, blanks are kept, empty strings and NULL are both an empty field,
NaN is empty, booleans are ``True``/``False``, dates ``yyyy-MM-dd``, and
doubles are written as Python's ``repr`` does (``2200000000.0``, ``0.0001``,
``1e-05``). A timestamp is ``yyyy-MM-dd HH:mm:ss`` with six more digits where
its microseconds are not zero; pandas chooses one form for a whole column,
which would need a pass over it, so there the text can differ in trailing
``.000000`` or a midnight ``00:00:00``. Nested columns are not supported, as
in Spark's own writer.

The row count comes from an ``Observation`` on the write itself, so the
result is computed once, not once to count and again to write.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, TimestampNTZType, TimestampType

# Writer options that give pandas-compatible CSV text.
CSV_OPTIONS = {
    "header": "true",
    "emptyValue": "",
    "nullValue": "",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "dateFormat": "yyyy-MM-dd",
}


def _float_text(value: Column) -> Column:
    """Python's ``repr`` of a double from Java's digits of it."""
    text = F.abs(value).cast("string")
    sign = F.when(text == "NaN", "").when((value < 0) | value.cast("string").startswith("-"), "-").otherwise("")
    mantissa, power = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
    digits = F.when(F.length(digits) == 0, "0").otherwise(digits)
    whole = F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
    rest = F.substr(digits, power + 2)
    plain = F.concat(whole, F.lit("."), F.when(F.length(rest) == 0, "0").otherwise(rest))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    tail = F.substr(digits, F.lit(2))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(F.length(tail) > 0, F.concat(F.lit("."), tail)).otherwise(""),
                          F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    long_power = F.concat(F.substring(digits, 1, 1), F.when(F.length(tail) > 0, F.concat(F.lit("."), tail)).otherwise(""),
                          F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string"))
    return F.concat(sign, F.when(text == "NaN", "").when(text == "Infinity", "inf").when(~text.contains("E"), text)
                    .when((power >= 0) & (power < 16), plain).when((power < 0) & (power >= -4), small)
                    .when(F.abs(power) >= 100, long_power).otherwise(scientific))


def _timestamp_text(value: Column) -> Column:
    second = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    fraction = F.date_format(value, "SSSSSS")
    return F.when(fraction == "000000", second).otherwise(F.concat(second, F.lit("."), fraction))


def _text(name: str, kind: DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(kind, (DoubleType, FloatType)):
        return _float_text(value).alias(name)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return _timestamp_text(value).alias(name)
    if isinstance(kind, BooleanType):
        return F.when(value, "True").when(~value, "False").alias(name)
    return value


@dataclass(frozen=True)
class WriteReport:
    """What a write produced: where, how many rows, and how long it took."""

    path: str
    rows: int
    seconds: float


def write_observed(df: DataFrame, write) -> tuple[int, float]:
    """Run ``write(observed_df)`` and return (rows written, seconds)."""
    obs = Observation("orderscope_write")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    start = time.perf_counter()
    write(observed)
    seconds = time.perf_counter() - start
    return int(obs.get["rows"]), seconds


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> WriteReport:
    """Write ``df`` as CSV part files under ``path``; report rows and time."""
    def write(d: DataFrame) -> None:
        text = d.select(*[_text(f.name, f.dataType) for f in d.schema.fields])
        text.write.mode(mode).options(**CSV_OPTIONS).csv(path)

    rows, seconds = write_observed(df, write)
    return WriteReport(path, rows, seconds)


def measure(df: DataFrame) -> WriteReport:
    """Run ``df`` to the ``noop`` sink: the row count and elapsed time the
    explorer shows after an ad-hoc query, computed in one pass without
    collecting the result."""
    def write(d: DataFrame) -> None:
        d.write.format("noop").mode("overwrite").save()

    rows, seconds = write_observed(df, write)
    return WriteReport("noop", rows, seconds)
