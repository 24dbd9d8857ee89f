"""Instrument and date keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelwright.functions.numeric import col

INSTRUMENT = "stock_id"
DATE = "trade_date"
ID_WIDTH = 6


def normalized_id(c: str | Column) -> Column:
    """Six-digit instrument id: trimmed, exchange prefix and decimals removed.

    Numeric ids are zero-padded and never cut; missing ids become ''.
    """
    text = F.trim(col(c).cast("string"))
    bare = F.split_part(F.regexp_replace(text, r"(sh|sz|SH|SZ)\.", ""), F.lit("."), F.lit(1))
    return (
        F.when(text.isNull() | (F.lower(text) == "nan"), F.lit(""))
        .when(bare.rlike("^[0-9]+$"), zero_padded(bare))
        .otherwise(bare)
    )


def zero_padded(c: str | Column) -> Column:
    """Left-padded with zeros to six characters; longer text stays whole."""
    c = col(c)
    return F.when(F.length(c) < ID_WIDTH, F.lpad(c, ID_WIDTH, "0")).otherwise(c)


def is_six_digit(c: str | Column) -> Column:
    return col(c).rlike("^[0-9]{6}$")


DAY_PATTERN = "[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"
TIME_PATTERN = "[ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?( ?(Z|UTC|[+-][0-9]{2}:?[0-9]{2}))?"


def parsed_date(c: str | Column) -> Column:
    """Calendar date from a date, timestamp or text column; NULL if unreadable.

    Text must be a whole date or a whole timestamp: anything behind it makes it unreadable.
    """
    c = col(c)
    text = F.trim(c.cast("string"))
    text = F.when(text.rlike("^[0-9]{8}$") | text.rlike(f"^{DAY_PATTERN}({TIME_PATTERN})?$"), text)
    compact = F.when(
        text.rlike("^[0-9]{8}$"),
        F.concat_ws("-", text.substr(1, 4), text.substr(5, 2), text.substr(7, 2)),
    )
    dashed = F.regexp_replace(text, "/", "-")
    return F.coalesce(compact, dashed).try_cast("date")
