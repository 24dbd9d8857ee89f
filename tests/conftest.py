import datetime as dt
import math
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

BARS_SCHEMA = "stock_id string, trade_date date, open double, close double, high double, low double"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def business_days(start: str, count: int) -> list[dt.date]:
    day, out = dt.date.fromisoformat(start), []
    while len(out) < count:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


def sine_rows(days: int = 80, stocks: int = 20):
    rows = []
    for s in range(stocks):
        for n, date in enumerate(business_days("2025-09-01", days)):
            close = 100.0 + s + 0.05 * n + math.sin(n / (3.0 + s / 10.0))
            rows.append((f"{s:06d}", date, close - 0.1, close, close + 0.2, close - 0.2))
    return rows


@pytest.fixture(scope="session")
def sine_bars(spark):
    """20 instruments x 80 business days of deterministic waves."""
    return spark.createDataFrame(sine_rows(), BARS_SCHEMA).cache()


@pytest.fixture(scope="session")
def last_scores(spark):
    """Scores 1.0 down to 0.0 on the last date of the waves."""
    last = business_days("2025-09-01", 80)[-1]
    rows = [(f"{s:06d}", last, 1.0 - s / 19.0) for s in range(20)]
    return spark.createDataFrame(rows, "stock_id string, trade_date date, pred_score double")


def scored_rows(days: int, stocks: int = 6):
    return [
        (date, f"{s:06d}", (s - 2) / 100.0, float(s)) for date in business_days("2026-01-01", days) for s in range(stocks)
    ]


@pytest.fixture(scope="session")
def scored(spark):
    def make(days: int = 40):
        return spark.createDataFrame(
            scored_rows(days), "trade_date date, stock_id string, future_return double, pred_score double"
        )

    return make


@pytest.fixture(scope="session")
def gappy_bars(spark):
    """Gaps, zero volume, missing amount and turnover, a flat, a one-row and an early-ending instrument."""
    days = business_days("2026-01-05", 25)
    rows = []
    for s, name in enumerate(("000001", "000002", "000003", "000004", "000005")):
        for n, date in enumerate(days):
            if name == "000001" and n == 7 or name == "000004" and n > 0 or name == "000005" and n > 15:
                continue
            close = 10.0 if name == "000003" else 10.0 + s + math.sin(n * (s + 1))
            volume = 0.0 if name == "000002" and n in (4, 5) else 100.0 if name == "000003" else 50.0 + 10 * ((n * 7 + s) % 5)
            amount = None if name == "000002" and n % 6 == 2 else volume * close * 1.01
            turn = None if (n + s) % 3 == 0 else 1.0 + n / 10
            rows.append((name, date, close - 0.05, close, close + 0.1, close - 0.2, volume, amount, 2.0, 0.1, 1.0, turn))
    schema = BARS_SCHEMA + (
        ", volume double, amount double, amplitude double, change_amount double, pct_chg double, turnover_rate double"
    )
    return spark.createDataFrame(rows, schema).cache()
