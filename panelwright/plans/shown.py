"""Comparable output: fixed rounding and plain types for result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

DIGITS = 6


def damped(c: str | Column) -> Column:
    """Signed log1p, for ratios whose tiny denominators make them huge."""
    c = F.col(c) if isinstance(c, str) else c
    return F.signum(c) * F.log1p(F.abs(c))


def shown(df: DataFrame, *columns: str, wide: Sequence[str] = (), digits: int = DIGITS) -> DataFrame:
    """The columns with rounded doubles, text dates and lists, and whole numbers as BIGINT."""
    out = []
    for field in df.select(*(columns or df.columns)).schema.fields:
        c = F.col(field.name)
        kind = field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            value = damped(c) if field.name in wide else c
            c = F.round(value, digits) + F.lit(0.0)
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.ArrayType):
            c = F.concat_ws(",", c)
        elif isinstance(kind, T.BooleanType):
            c = c.cast("int").cast("bigint")
        elif isinstance(kind, (T.IntegerType, T.LongType, T.DecimalType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)
