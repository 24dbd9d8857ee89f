"""Date-level tables: index, rebalance dates and membership by date.

A table with one row per calendar date is bounded by the calendar itself
(about 37 000 dates a century), whatever the number of instruments, so it may
be ordered in one task and broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelwright.functions.checks import require
from panelwright.functions.keys import DATE, INSTRUMENT


def broadcast_dates(table: DataFrame) -> DataFrame:
    """Broadcast hint for a table with a bounded number of rows per calendar date."""
    return F.broadcast(table)


def date_index(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct dates (per fold or model) with their 0-based position and count."""
    dates = panel.select(*by, DATE).where(F.col(DATE).isNotNull()).distinct()
    ordered = Window.partitionBy(*by).orderBy(DATE)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return dates.select(
        *by,
        DATE,
        (F.row_number().over(ordered) - 1).alias("date_index"),
        F.count(F.lit(1)).over(whole).cast("int").alias("dates"),
    )


def rebalance_dates(panel: DataFrame, stride: int, by: Sequence[str] = ()) -> DataFrame:
    """Every ``stride``-th distinct date, starting with the first."""
    require(stride=(stride, stride >= 1, "1 or more"))
    chosen = date_index(panel, by).where(F.col("date_index") % stride == 0)
    return chosen.select(*by, DATE, "date_index")


def with_date_group(panel: DataFrame, name: str = "qid") -> DataFrame:
    """Dense 0-based group number of the date."""
    index = date_index(panel).select(DATE, F.col("date_index").cast("int").alias(name))
    return panel.join(broadcast_dates(index), DATE)


def on_dates(panel: DataFrame, dates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose date (and fold or model) is listed."""
    return panel.join(broadcast_dates(dates.select(*by, DATE).distinct()), [*by, DATE], "left_semi")


def not_on_dates(panel: DataFrame, dates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose date (and fold or model) is not listed."""
    return panel.join(broadcast_dates(dates.select(*by, DATE).distinct()), [*by, DATE], "left_anti")


def latest_rows(panel: DataFrame, rows: int = 1) -> DataFrame:
    """The last ``rows`` rows of every instrument by date."""
    place = F.row_number().over(Window.partitionBy(INSTRUMENT).orderBy(F.col(DATE).desc()))
    return panel.withColumn("_place", place).where(F.col("_place") <= rows).drop("_place")


def of_instruments(panel: DataFrame, instruments: DataFrame) -> DataFrame:
    """Rows of the listed instruments; the planner picks the join by measured size."""
    return panel.join(instruments.select(INSTRUMENT).distinct(), INSTRUMENT, "left_semi")
