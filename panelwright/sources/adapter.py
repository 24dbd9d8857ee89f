"""Weekly bars from an order-line table: one instrument per supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwright.functions.keys import DATE, INSTRUMENT, zero_padded
from panelwright.functions.numeric import ratio, simple_return

COLUMNS = (
    "stock_id", "trade_date", "open", "close", "high", "low", "volume", "amount",
    "amplitude", "change_amount", "pct_chg", "turnover_rate",
)


def lineitem_bars(lineitem: DataFrame) -> DataFrame:
    """One bar per supplier and week; aggregated map-side, so a hot supplier is harmless."""
    px = F.lit(100.0) + F.col("l_extendedprice") / F.lit(1000.0)
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    shipped = F.col("l_shipdate").cast("date")
    week = F.date_sub(shipped, F.weekday(shipped))
    new_lines = F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")))
    bars = (
        lineitem.groupBy("l_suppkey", week.alias(DATE))
        .agg(
            F.min_by(px, order).alias("open"),
            F.max_by(px, order).alias("close"),
            F.max(px).alias("high"),
            F.min(px).alias("low"),
            F.sum("l_quantity").alias("volume"),
            F.sum(px * F.col("l_quantity")).alias("amount"),
            (F.lit(100.0) * new_lines / F.lit(10000.0)).alias("turnover_rate"),
        )
        .withColumn(INSTRUMENT, zero_padded(F.col("l_suppkey").cast("string")))
    )
    before = F.lag("close").over(Window.partitionBy(INSTRUMENT).orderBy(DATE))
    return bars.withColumns(
        {
            "amplitude": ratio(F.col("high") - F.col("low"), before) * F.lit(100.0),
            "change_amount": F.col("close") - before,
            "pct_chg": simple_return(F.col("close"), before) * F.lit(100.0),
        }
    ).select(*COLUMNS)


def load_bars(spark: SparkSession, folder: str) -> DataFrame:
    return lineitem_bars(spark.read.parquet(f"{folder}/lineitem.parquet"))
