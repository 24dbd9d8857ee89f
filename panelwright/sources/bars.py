"""Reading, standardising and splitting bar tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwright.functions.keys import DATE, INSTRUMENT, normalized_id, parsed_date
from panelwright.functions.numeric import col, ratio, to_double

# Accepted header names per canonical column, first match wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "stock_id": ("stock_id", "StockID", "ticker", "symbol", "股票代码"),
    "trade_date": ("trade_date", "date", "日期"),
    "open": ("open", "开盘"),
    "close": ("close", "收盘"),
    "high": ("high", "最高"),
    "low": ("low", "最低"),
    "volume": ("volume", "成交量"),
    "amount": ("amount", "成交额"),
    "amplitude": ("amplitude", "振幅"),
    "change_amount": ("change_amount", "涨跌额"),
    "pct_chg": ("pct_chg", "涨跌幅"),
    "turnover_rate": ("turnover_rate", "turnover", "换手率"),
}
REQUIRED = ("stock_id", "trade_date", "open", "close", "high", "low", "volume")
# Columns of the constituent list and of the exchange feed.
CONSTITUENT_COLUMNS = ("updateDate", "code", "code_name", "stock_id")
EXCHANGE_FEED = ("date", "code", "open", "high", "low", "close", "volume", "amount", "turn", "pctChg")


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def read_text_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with a header; every column stays text, so ids keep leading zeros."""
    try:
        table = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"data file not found: {path}") from error
        raise
    if not table.columns:
        raise ValueError(f"data file is empty: {path}")
    return table


def read_bars(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv") -> DataFrame:
    """Standardised bars from CSV or Parquet; several paths are read as one table."""
    if fmt == "csv":
        return standardize_bars(read_text_table(spark, path))
    if fmt == "parquet":
        paths = [path] if isinstance(path, str) else list(path)
        return standardize_bars(spark.read.parquet(*paths))
    raise ValueError(f"unsupported bar format: {fmt}")


def find_column(columns: Iterable[str], names: Sequence[str]) -> str | None:
    """The column bearing one of the names: exact after trimming, then ignoring case."""
    trimmed = {c.strip(): c for c in columns}
    for name in names:
        if name in trimmed:
            return trimmed[name]
    lowered = [n.lower() for n in names]
    return next((c for c in trimmed.values() if c.strip().lower() in lowered), None)


def instrument_column(columns: Iterable[str]) -> str:
    found = find_column(columns, ALIASES[INSTRUMENT])
    if found is None:
        raise ValueError(f"no instrument column; accepted names: {', '.join(ALIASES[INSTRUMENT])}")
    return found


def standardize_bars(raw: DataFrame) -> DataFrame:
    """Canonical names and types; rows lacking a required value are dropped.

    Unreadable numbers and dates become NULL; unknown columns are left out.
    """
    found = {name: find_column(raw.columns, aliases) for name, aliases in ALIASES.items()}
    missing = [name for name in REQUIRED if found[name] is None]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")

    def typed(name: str, source: str):
        if name == INSTRUMENT:
            return normalized_id(quoted(source))
        return parsed_date(quoted(source)) if name == DATE else to_double(quoted(source))

    bars = raw.select(*[typed(n, s).alias(n) for n, s in found.items() if s is not None])
    return bars.dropna(subset=list(REQUIRED))


def derive_bar_fields(feed: DataFrame) -> DataFrame:
    """Bars from an exchange feed: range, change and plain ids derived.

    Without a ``preclose`` column the previous close of the instrument is used.
    """
    missing = [c for c in EXCHANGE_FEED if c not in feed.columns]
    if missing:
        raise ValueError(f"feed columns are missing: {missing}")
    numbers = [c for c in (*EXCHANGE_FEED[2:], "preclose") if c in feed.columns]
    typed = feed.withColumns(
        {n: to_double(n) for n in numbers}
        | {DATE: parsed_date("date"), INSTRUMENT: normalized_id("code")}
    )
    if "preclose" not in feed.columns:
        history = Window.partitionBy(INSTRUMENT).orderBy(DATE)
        typed = typed.withColumn("preclose", F.lag("close").over(history))
    return typed.select(
        INSTRUMENT,
        DATE,
        "open",
        "close",
        "high",
        "low",
        "volume",
        "amount",
        F.col("turn").alias("turnover_rate"),
        F.col("pctChg").alias("pct_chg"),
        (ratio(F.col("high") - F.col("low"), F.col("preclose")) * F.lit(100.0)).alias("amplitude"),
        (F.col("close") - F.col("preclose")).alias("change_amount"),
    )


def union_histories(histories: Sequence[DataFrame]) -> DataFrame:
    """All histories as one table."""
    if not histories:
        raise ValueError("no histories to combine")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), histories)


def profile(raw: DataFrame) -> DataFrame:
    """One row: rows, columns, distinct instruments and the detected key columns."""
    try:
        instrument = instrument_column(raw.columns)
        instruments = F.count_distinct(quoted(instrument))
    except ValueError:
        instrument, instruments = "", F.lit(0).cast("bigint")
    return raw.agg(F.count(F.lit(1)).alias("row_count"), instruments.alias("unique_stock_count")).select(
        "row_count",
        F.lit(len(raw.columns)).cast("bigint").alias("column_count"),
        F.lit(instrument).alias("stock_id_column"),
        "unique_stock_count",
        F.lit(find_column(raw.columns, ALIASES[DATE]) or "").alias("date_column"),
    )


def _boundary(value: str | dt.date, label: str) -> dt.date:
    try:
        return value if isinstance(value, dt.date) else dt.date.fromisoformat(value.strip())
    except ValueError as error:
        raise ValueError(f"{label} is not a date: {value!r}") from error


def split_by_dates(
    bars: DataFrame,
    train: tuple[str | dt.date, str | dt.date],
    test: tuple[str | dt.date, str | dt.date],
) -> tuple[DataFrame, DataFrame]:
    """Rows inside two inclusive date ranges. Unreadable dates in the data are an error."""
    instrument = find_column(bars.columns, ("stock_id", "股票代码"))
    date = find_column(bars.columns, ("trade_date", "日期"))
    if instrument is None or date is None:
        if set(CONSTITUENT_COLUMNS) <= set(bars.columns):
            raise ValueError("this is a constituents list, not bar history")
        raise ValueError("instrument or date column is missing")
    when = parsed_date(quoted(date))
    checked = F.when(when.isNull(), F.raise_error(F.lit("unreadable date in the data"))).otherwise(when)
    typed = bars.withColumn(date, checked)

    def part(bounds, label: str) -> DataFrame:
        first, last = (_boundary(b, f"{label} {end}") for b, end in zip(bounds, ("start", "end")))
        if first > last:
            raise ValueError(f"{label} range starts after it ends")
        return typed.where(quoted(date).between(F.lit(first), F.lit(last)))

    return part(train, "train"), part(test, "test")
