"""Exact money arithmetic as column expressions (the numeric recipe).

Prices in the inputs may be doubles. A double sum depends on the order in
which rows meet, i.e. on partitioning, so money is never summed as double.
An amount becomes a whole number of *units* of 10^-scale, a ``long``:

* a decimal column has the scale of its schema, so nothing is lost;
* an integer column has scale 0;
* a double column has a scale the caller states (:data:`DEFAULT_SCALE`
  otherwise). A value that is not a multiple of 10^-scale, is not finite or
  does not fit is an error that names the column. Nothing is rounded: a
  result is either the exact sum or no result.

That error is not raised row by row. A sum carries, beside its total, the
largest value that has no exact units (``<name>_bad``, null in a sound group):
a plain maximum, merged like the total, which costs the scan a comparison
where a conditional error per row kept the compiler from tight code. Whoever
takes the finished total of a group raises the error if there is such a value.

``price * (1 - discount)`` multiplies units of both, at the sum of their
scales. Totals are kept as two ``long`` limbs — ``units >> 23`` and
``units & (2^23 - 1)`` — in fixed-width buffers inside whole-stage codegen.
They are exact while a group has fewer than 2^40 (about 1.1e12) rows and the
sum of its units is below 2^86, with ANSI mode on or off. Only a finished
total is recombined as a decimal and converted to double, correctly rounded;
a mean is that total over the count of non-null inputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

# Decimal places of amounts that arrive as doubles, unless the caller says
# otherwise, and the width of a split sum's low limb.
DEFAULT_SCALE = 4
LOW_LIMB_BITS = 23
# Beyond this many units a double cannot tell neighbouring multiples apart.
MAX_DOUBLE_UNITS = 1 << 53
# Products of units stay below this, a margin under the range of a long.
MAX_PRODUCT = float(1 << 62)


@dataclass(frozen=True)
class Amount:
    """A column in whole units of 10^-scale; ``present`` is the input, to be
    counted for means, ``bad`` an input value (double) that has no exact
    units, which are null then. ``label`` and ``why`` go into the error."""

    units: Column
    scale: int
    present: Column
    bad: Column
    label: str
    why: str


def _unfit(fits: Column, column: Column) -> tuple[Column, Column]:
    """(condition that units exist, the offending value as double)."""
    return fits, F.when(~fits, column.cast("double"))


def amount(df: DataFrame, name: str, scale: int = DEFAULT_SCALE) -> Amount:
    """The named column of ``df`` in exact units. ``scale`` applies to doubles."""
    column, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, DecimalType):
        units = (column * F.lit(Decimal(10) ** kind.scale)).try_cast("long")
        _, bad = _unfit(units.isNotNull() | column.isNull(), column)
        return Amount(units, kind.scale, column, bad, name, "does not fit")
    if not isinstance(kind, (DoubleType, FloatType)):
        return Amount(column.cast("long"), 0, column, F.lit(None).cast("double"), name, "does not fit")
    value = column.cast("double")
    whole = F.rint(value * F.lit(float(10 ** scale)))
    # The quotient is correctly rounded, so it is the value again exactly when
    # the value is the double of a multiple of 10^-scale. NaN compares as
    # larger than any number.
    fits, bad = _unfit((F.abs(whole) <= F.lit(float(MAX_DOUBLE_UNITS)))
                       & (whole / F.lit(float(10 ** scale)) == value), value)
    return Amount(F.when(fits, whole.cast("long")), scale, column, bad, name,
                  f"is not a multiple of 10^-{scale} within range")


def net_amount(price: Amount, discount: Amount) -> Amount:
    """``price * (1 - discount)`` in exact units at the sum of the scales."""
    rest = F.lit(10 ** discount.scale).cast("long") - discount.units
    # The double product is within a factor of 1 + 2^-50 of the exact one.
    fits = F.abs(price.units.cast("double") * rest.cast("double")) < F.lit(MAX_PRODUCT)
    present = F.when(discount.present.isNotNull(), price.present)
    bad = F.coalesce(price.bad, discount.bad, F.when(~fits, price.present.cast("double")))
    return Amount(F.when(fits, price.units * rest), price.scale + discount.scale, present, bad,
                  f"{price.label} * (1 - {discount.label})", f"{price.why} or the product does not fit")


def split_sum(value: Amount | Column, name: str) -> list[Column]:
    """Aggregate columns ``<name>_hi``, ``<name>_lo``: the exact total of an
    amount or a ``long`` column, kept as two long limbs (see the module notes),
    and ``<name>_bad``: a value that has no exact units, if there is one."""
    units, bad = (value.units, value.bad) if isinstance(value, Amount) else (value, F.lit(None).cast("double"))
    low_mask = (1 << LOW_LIMB_BITS) - 1
    return [F.sum(F.shiftright(units, LOW_LIMB_BITS)).alias(f"{name}_hi"),
            F.sum(units.bitwiseAND(F.lit(low_mask))).alias(f"{name}_lo"),
            F.max(bad).alias(f"{name}_bad")]


def merge_split(name: str) -> list[Column]:
    """Aggregate columns merging partial sums from :func:`split_sum`."""
    return [F.sum(f"{name}_hi").alias(f"{name}_hi"), F.sum(f"{name}_lo").alias(f"{name}_lo"),
            F.max(f"{name}_bad").alias(f"{name}_bad")]


def split_parts(name: str) -> list[str]:
    """The columns of a split sum."""
    return [f"{name}_hi", f"{name}_lo", f"{name}_bad"]


def split_total(name: str, of: Amount | None = None) -> Column:
    """The limbs recombined: the exact total in units, ``decimal(38,0)``; NULL
    over no non-null input; an error if a value had no exact units."""
    total = (F.col(f"{name}_hi").cast("decimal(38,0)") * F.lit(1 << LOW_LIMB_BITS)
             + F.col(f"{name}_lo").cast("decimal(38,0)")).cast("decimal(38,0)")
    label, why = (of.label, of.why) if of is not None else (name, "does not fit")
    bad = F.col(f"{name}_bad")
    return F.when(bad.isNotNull(), F.raise_error(
        F.concat(F.lit(f"amount {label}: "), bad.cast("string"), F.lit(f" {why}"))).cast("decimal(38,0)")).otherwise(total)


def units_value(total: str | Column, scale: int) -> Column:
    """A total in units as double, correctly rounded."""
    total = F.col(total) if isinstance(total, str) else total
    return (total.cast("decimal(38,0)") * F.lit(Decimal(1).scaleb(-scale))).cast("double")


def units_mean(total: str | Column, scale: int, count: str | Column) -> Column:
    """Mean from a total in units and the count of the values summed; NULL
    (not an error) when the count is zero or NULL."""
    return F.try_divide(units_value(total, scale), F.col(count) if isinstance(count, str) else count)


def split_value(name: str, of: Amount | int) -> Column:
    """The limbs of an amount's sum as a double in whole amounts, correctly
    rounded. A scale alone stands for a plain ``long`` column."""
    return units_value(split_total(name, None if isinstance(of, int) else of), of if isinstance(of, int) else of.scale)


def split_mean(name: str, of: Amount, count: str | Column) -> Column:
    """The limbs over a count."""
    return units_mean(split_total(name, of), of.scale, count)
