"""Number cleaning, units and small numeric features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

def to_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null.

    Java's parser also takes type suffixes, hexadecimals and NaN, so texts with such letters are left out.
    """
    plain = F.translate(text, "dDfFxXpPnN", "") == text
    infinite = F.lower(F.trim(text)).isin("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")
    return F.when(plain | infinite, text.try_cast("double"))


def null_fill(value: Column, equals: float | None = None, at_most: float | None = None) -> Column:
    """Sentinel values and NaN to null."""
    keep = ~F.isnan(value)
    if equals is not None:
        keep = keep & (value != F.lit(equals))
    if at_most is not None:
        keep = keep & (value > F.lit(at_most))
    return F.when(keep, value)


def feet_to_m(value: Column) -> Column:
    return value * F.lit(0.3048)


def inches_to_mm(value: Column) -> Column:
    return value * F.lit(25.4)


def fahrenheit_to_c(value: Column) -> Column:
    return (value - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


def scaled(value: Column, slope: float | Column, intercept: float | Column) -> Column:
    slope = slope if isinstance(slope, Column) else F.lit(float(slope))
    intercept = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    return value * slope + intercept


def clip_low(value: Column, low: float) -> Column:
    """Lower bound that keeps null (greatest alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def log_drainage(area: Column) -> Column:
    return F.when(area.isNotNull(), F.log10(F.greatest(area, F.lit(1.0))))
