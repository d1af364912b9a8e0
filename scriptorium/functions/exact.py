"""Means and shares over whole numbers, so a rounded result hangs neither on the order of the rows nor on a binary fraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values are taken to so many places before they are added up.
DIGITS = 6


def rounded_ratio(part: Column, whole: Column) -> Column:
    """part / whole to the nearest whole number, halves away from zero; null where whole is 0."""
    twice = F.nullif(2 * whole, F.lit(0))
    size = F.call_function("div", 2 * F.abs(part) + whole, twice)
    return F.when(part < 0, -size).otherwise(size)


def exact_mean(value: Column, places: int = 4) -> Column:
    """An aggregate: the mean of a column's values that are not null, to `places` places (DIGITS at most)."""
    total = F.sum(F.round(value * 10**DIGITS).cast("long"))
    return rounded_ratio(total, F.count(value) * 10 ** (DIGITS - places)) / F.lit(float(10**places))


def exact_share(part: Column, whole: Column, places: int = DIGITS) -> Column:
    """part / whole of two counts, to `places` places."""
    return rounded_ratio(part * 10**places, whole) / F.lit(float(10**places))
