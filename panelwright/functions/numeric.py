"""Numeric column helpers. Missing is always SQL NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 1e-12


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NULL unless the value is a finite number."""
    c = col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """numerator / (denominator + 1e-12); NULL instead of a division error."""
    return F.try_divide(col(numerator), col(denominator) + F.lit(EPSILON))


def simple_return(now: Column, before: Column) -> Column:
    """now / before - 1; NULL when before is missing or zero."""
    return F.try_divide(now, before) - F.lit(1.0)


def zero_filled(c: str | Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def clamp(c: Column, low: Column, high: Column) -> Column:
    """Clip to [low, high]; a NULL bound leaves that side open."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def rounded(c: str | Column, digits: int = 8) -> Column:
    """Rounded value without negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def to_double(c: str | Column) -> Column:
    """Number from any column; NULL where it cannot be read as a finite one."""
    return finite(col(c).try_cast("double"))
