import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright.functions.keys import normalized_id
from panelwright.operators import picks, quality
from panelwright.plans.inference import score_picks
from panelwright.sources import bars, sinks
from tests.conftest import business_days

HEADER = "股票代码,日期,开盘,收盘,最高,最低,成交量,其他"


def test_csv_with_foreign_headers(spark, tmp_path):
    lines = [HEADER, "sh.600000,2026-01-05,1.0,2,3,0.5,10,x", "1.0,2026/1/6,1,2,3,0.5,n/a,x", "000001,bad,1,2,3,0.5,7,x",
             "1,20260107,1,2,3,0.5,7,x", " 000002 ,2026-01-08,,2,3,0.5,7,x"]
    path = tmp_path / "bars.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    found = bars.read_bars(spark, str(path)).orderBy("stock_id").collect()
    assert [(r.stock_id, r.trade_date) for r in found] == [
        ("000001", dt.date(2026, 1, 7)), ("600000", dt.date(2026, 1, 5)),
    ]
    assert "其他" not in found[0].asDict()


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bars.read_bars(spark, str(tmp_path / "none.csv"))
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError, match="empty"):
        bars.read_bars(spark, str(empty))
    with pytest.raises(ValueError, match="required"):
        bars.standardize_bars(spark.createDataFrame([("1",)], "stock_id string"))


@pytest.mark.parametrize(
    "raw, expected",
    [("1", "000001"), (" sz.000002 ", "000002"), ("SH.600000", "600000"), ("7.0", "000007"), ("nan", ""), ("", ""),
     (None, ""), ("1234567", "1234567"), ("abc", "abc")],
)
def test_ids(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "i string").select(normalized_id("i")).first()[0] == expected


def test_date_split_errors(spark, gappy_bars):
    train, test = bars.split_by_dates(gappy_bars, ("2026-01-05", "2026-01-09"), ("2026-01-12", "2026-01-12"))
    assert train.select("trade_date").distinct().count() == 5 and test.select("trade_date").distinct().count() == 1
    with pytest.raises(ValueError, match="not a date"):
        bars.split_by_dates(gappy_bars, ("soon", "2026-01-09"), ("2026-01-12", "2026-01-12"))
    with pytest.raises(ValueError, match="after it ends"):
        bars.split_by_dates(gappy_bars, ("2026-01-10", "2026-01-09"), ("2026-01-12", "2026-01-12"))
    listed = spark.createDataFrame([("a", "b", "c", "1")], "updateDate string, code string, code_name string, stock_id string")
    with pytest.raises(ValueError, match="constituents"):
        bars.split_by_dates(listed, ("2026-01-05", "2026-01-09"), ("2026-01-12", "2026-01-12"))


def test_feed_with_preclose(spark):
    row = ("2026-01-05", "sh.600000", "10", "11", "9", "10.5", "10", "100", "1000", "1.5", "5")
    names = "date code open high low close preclose volume amount turn pctChg".split()
    bar = bars.derive_bar_fields(spark.createDataFrame([row], names)).first()
    assert bar.stock_id == "600000" and bar.change_amount == 0.5 and bar.amplitude == pytest.approx(20.0)
    assert bar.turnover_rate == 1.5 and bar.pct_chg == 5.0


def test_sinks_round_trip(spark, gappy_bars, tmp_path):
    path = str(tmp_path / "bars")
    sinks.write_bars(gappy_bars, path)
    again = bars.read_bars(spark, path, "parquet")
    one, two = (sinks.fingerprint(d.select(*gappy_bars.columns)).first() for d in (gappy_bars, again.repartition(5)))
    assert one == two and one.row_count == gappy_bars.count()
    assert sinks.fingerprint(gappy_bars.limit(3)).first().sha256 != one.sha256
    chosen = spark.createDataFrame([("000002", 0.5), ("000001", 0.5)], "stock_id string, weight double")
    sinks.write_picks(chosen, str(tmp_path / "picks"))
    assert [r.stock_id for r in bars.read_text_table(spark, str(tmp_path / "picks")).collect()] == ["000001", "000002"]
    sinks.write_report(chosen, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def market(days=60, *, invalid=False, extra=False):
    rows = []
    for s in range(2):
        for date in business_days("2026-01-01", days):
            close = 10.0 + s
            rows.append((f"{s + 1:06d}", date.isoformat(), close, close, close + (-1.0 if invalid else 0.5), close - 0.5, 100.0, 1000.0, 1.0, 0.0))
    return rows + rows[:1] if extra else rows


MARKET = "stock_id string, trade_date string, open double, close double, high double, low double, volume double, amount double, turnover_rate double, pct_chg double"


@pytest.mark.parametrize(
    "options, cutoff, failure",
    [
        ({}, "2026-03-25", None),
        ({"invalid": True, "extra": True}, "2026-03-25", "duplicate keys"),
        ({"invalid": True}, "2026-03-25", "invalid OHLC"),
        ({"days": 59}, "2026-03-25", "latest date is not the cutoff"),
        ({"days": 59}, "2026-03-24", "short history"),
    ],
)
def test_quality_rules(spark, options, cutoff, failure):
    table = spark.createDataFrame(market(**options), MARKET)
    report = quality.quality_report(table, dt.date.fromisoformat(cutoff), minimum_stock_count=2)
    assert report.first().first_failure == failure
    if failure is None:
        row = quality.require(report).first()
        assert (row.stock_count, row.latest_day_stock_count, row.short_history_stock_count) == (2, 2, 0)
    else:
        with pytest.raises(ValueError, match=failure):
            quality.require(report)


def test_quality_counts_copies_beyond_the_first(spark):
    table = spark.createDataFrame(market(3) * 2 + market(3)[:1], MARKET)
    assert quality.quality_report(table, dt.date(2026, 1, 5)).first().duplicate_key_count == 7


def pick_table(spark, rows):
    return spark.createDataFrame(rows, "stock_id string, weight double")


@pytest.mark.parametrize(
    "rows, failure",
    [
        ([(f"{i:06d}", 0.2) for i in range(5)], None),
        ([(f"{i:06d}", 0.2) for i in range(4)], "wrong number of picks"),
        ([("000000", 0.2)] * 5, "duplicate instrument id"),
        ([(f"{i:06d}", w) for i, w in enumerate([0.3, 0.2, 0.2, 0.2, 0.1])], "unequal weight"),
        ([(f"{i:06d}", 0.2) for i in range(6)], "too many picks"),
        ([("", 0.2), *[(f"{i:06d}", 0.2) for i in range(4)]], "empty instrument id"),
        ([(f"{i + 7:06d}", 0.2) for i in range(5)], "instrument not allowed"),
        ([(f"{i:06d}", None) for i in range(5)], "unreadable weight"),
        ([(f"{i:06d}", -0.2) for i in range(5)], "negative weight"),
    ],
)
def test_pick_rules(spark, rows, failure):
    allowed = pick_table(spark, [(f"{i:06d}", 0.0) for i in range(10)])
    row = picks.picks_report(pick_table(spark, rows), exact_positions=5, exact_weight=0.2, allowed=allowed).first()
    assert row.first_failure == failure


def test_pick_headers(spark):
    with pytest.raises(ValueError, match="columns"):
        picks.picks_report(pick_table(spark, [("000001", 1.0)]).select("weight", "stock_id"))


def test_realised_score(spark, gappy_bars):
    chosen = pick_table(spark, [("1", 0.6), ("4", 0.3), ("99", 0.1)]).toDF("股票代码", "权重")
    opens = [r.open for r in gappy_bars.where("stock_id = '000001'").orderBy("trade_date").collect()]
    expected = 0.6 * (opens[-1] - opens[-5]) / opens[-5]
    row = score_picks(chosen, gappy_bars).first()
    assert row.score == pytest.approx(expected) and row.matched_count == 2
    both = score_picks(chosen, gappy_bars, pick_table(spark, [("3", 1.0)])).first()
    assert both.baseline_score == 0.0 and both.delta_vs_baseline == pytest.approx(expected)
    assert both.rank_eligible == (expected > 0)
    with pytest.raises(PySparkException, match="no pick matches"):
        score_picks(pick_table(spark, [("99", 1.0)]), gappy_bars).collect()
    with pytest.raises(ValueError, match="too many"):
        score_picks(pick_table(spark, [(str(i), 0.1) for i in range(6)]), gappy_bars)
    with pytest.raises(ValueError, match="out of range"):
        score_picks(pick_table(spark, [("1", 0.9), ("2", 0.9)]), gappy_bars)


def test_equal_weights_close_the_sum(spark, last_scores):
    rows = picks.equal_weight_picks(last_scores, 3, by=()).orderBy("place").collect()
    assert [r.stock_id for r in rows] == ["000000", "000001", "000002"]
    assert [r.weight for r in rows] == [0.333333, 0.333333, 0.333334]
