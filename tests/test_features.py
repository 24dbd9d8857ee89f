"""Features against plain pandas on a small awkward panel."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import calendar, features

KEY = ["stock_id", "trade_date"]


@pytest.fixture(scope="module")
def full(gappy_bars):
    return features.build_features(gappy_bars, "full").toPandas().sort_values(KEY).reset_index(drop=True)


@pytest.fixture(scope="module")
def raw(gappy_bars):
    return gappy_bars.toPandas().sort_values(KEY).reset_index(drop=True)


def per_stock(raw, column, fn):
    return raw.groupby("stock_id")[column].transform(fn)


def check(full, name, expected):
    expected = pd.Series(expected).replace([np.inf, -np.inf], np.nan).fillna(0.0)
    assert np.allclose(full[name].astype(float), expected.astype(float), rtol=1e-9, atol=1e-9), name


def test_registry_sizes_and_order(gappy_bars):
    families = features.feature_families(gappy_bars.columns)
    assert [len(v) for v in families.values()] == [70, 11, 22, 10, 12]
    sizes = {"base": 70, "alpha": 81, "market": 92, "path": 80, "path2": 92, "cross": 102, "full": 125}
    for preset, size in sizes.items():
        names = features.preset_features(gappy_bars.columns, preset)
        assert len(names) == len(set(names)) == size
    alpha = features.preset_features(gappy_bars.columns, "alpha")
    assert alpha[12] == "close_to_vwap" and alpha[13] == "close_return_3" and alpha[55] == "delta_price_to_ma_10_3"
    assert alpha[56] == "close_return_1_cs_rank" and alpha[65] == "turnover_rate" and alpha[-1] == "pct_chg_cs_rank"


def test_unknown_names_fail(gappy_bars):
    with pytest.raises(ValueError, match="preset"):
        features.build_features(gappy_bars, "nothing")
    with pytest.raises(ValueError, match="not available"):
        features.build_features(gappy_bars, ["nothing"])
    with pytest.raises(ValueError, match="amount"):
        features.preset_features(["open"], "market")


def test_copies_of_keys_do_not_stop_a_long_history(gappy_bars):
    twice = gappy_bars.union(gappy_bars)
    made = features.build_features(twice, ["close_return_1", "price_to_ma_5"], keep=["stock_id"], max_history_rows=30)
    assert made.count() == twice.count()


def test_alpha_preset_is_fixed_with_more_windows():
    columns = ["open", "close", "high", "low", "volume", "amount", "amplitude", "change_amount", "pct_chg", "turnover_rate"]
    wide = features.preset_features(columns, "alpha", (3, 5, 10, 20, 60))
    assert wide == features.preset_features(columns, "alpha") and len(wide) == 81
    assert len(features.preset_features(columns, "alpha", (5, 10, 20))) < 81


def test_everything_is_finite(full):
    names = features.preset_features([*full.columns], "full")
    assert np.isfinite(full[names].astype(float).to_numpy()).all()


def test_rolling_features(full, raw):
    r = raw.groupby("stock_id")["close"].pct_change().fillna(0.0)
    raw = raw.assign(r=r)
    check(full, "close_return_1", r)
    volume = raw.groupby("stock_id")["volume"].pct_change()
    check(full, "volume_return_1", volume)
    for w in (3, 20):
        check(full, f"price_to_ma_{w}", raw["close"] / (per_stock(raw, "close", lambda s: s.rolling(w, min_periods=1).mean()) + 1e-12) - 1)
        check(full, f"volatility_{w}", per_stock(raw, "r", lambda s: s.rolling(w, min_periods=2).std()).where(lambda s: s > 1e-9, 0))
        check(full, f"amount_ratio_{w}", raw["amount"] / (per_stock(raw, "amount", lambda s: s.rolling(w, min_periods=1).mean()) + 1e-12))
        top = per_stock(raw, "high", lambda s: s.rolling(w, min_periods=1).max())
        check(full, f"high_breakout_{w}", raw["close"] / (top + 1e-12) - 1)
        mean = per_stock(raw, "turnover_rate", lambda s: s.rolling(w, min_periods=1).mean())
        check(full, f"turnover_ratio_{w}", raw["turnover_rate"].fillna(0) / (mean + 1e-12))
        back = raw.groupby("stock_id")["close"].pct_change(w)
        moved = per_stock(raw, "r", lambda s: s.abs().rolling(w, min_periods=1).sum())
        check(full, f"path_efficiency_{w}", back / (moved + 1e-12))
    check(full, "positive_day_ratio_5", per_stock(raw, "r", lambda s: s.gt(0).rolling(5, min_periods=1).mean()))


def test_volume_correlation(full, raw):
    raw = raw.assign(vwap=raw["amount"] / (raw["volume"] + 1e-12))
    for name, column in (("close", "close"), ("vwap", "vwap")):
        expected = []
        for _, part in raw.groupby("stock_id"):
            for n in range(len(part)):
                pair = part[[column, "volume"]].iloc[max(0, n - 9) : n + 1].dropna()
                flat = len(pair) < 2 or pair.std().min() == 0
                expected.append(0.0 if flat else np.corrcoef(pair[column], pair["volume"])[0, 1])
        check(full, f"{name}_volume_corr_10", expected)


def test_market_and_ranks(full, raw):
    r = raw.groupby("stock_id")["close"].pct_change().fillna(0.0)
    by_date = r.groupby(raw["trade_date"])
    check(full, "excess_return_1", r - by_date.transform("mean"))
    check(full, "market_up_ratio_1", by_date.transform(lambda s: (s > 0).mean()))
    check(full, "market_top_decile_return_1", by_date.transform(lambda s: s.nlargest(max(1, int(np.ceil(len(s) * 0.1)))).mean()))
    daily = by_date.std().rolling(5, min_periods=1).mean()
    check(full, "market_dispersion_trend_5", raw["trade_date"].map(daily))
    check(full, "close_return_1_cs_rank", by_date.rank(pct=True))
    turn = raw["turnover_rate"].fillna(0.0)
    check(full, "turnover_rate_cs_rank", turn.groupby(raw["trade_date"]).rank(pct=True))


def test_later_dates_do_not_change_earlier_features(gappy_bars, full):
    cut = dt.date(2026, 1, 23)
    early = features.build_features(gappy_bars.where(F.col("trade_date") <= F.lit(cut)), "full").toPandas()
    early = early.sort_values(KEY).reset_index(drop=True)
    later = full[full["trade_date"] <= cut].reset_index(drop=True)
    pd.testing.assert_frame_equal(early, later, check_exact=False, rtol=1e-12)


def test_partitioning_does_not_matter(gappy_bars, full):
    shuffled = gappy_bars.repartition(7, "volume")
    again = features.build_features(shuffled, ["price_to_ma_10", "excess_return_1"]).toPandas()
    again = again.sort_values(KEY).reset_index(drop=True)
    assert np.allclose(again["price_to_ma_10"], full["price_to_ma_10"])
    assert np.allclose(again["excess_return_1"], full["excess_return_1"])


def test_latest_rows_and_missing_features(gappy_bars):
    from panelwright.plans.panels import inference_panel

    panel = inference_panel(gappy_bars, ["price_to_ma_10", "unheard_of"]).toPandas()
    assert len(panel) == 5 and (panel["unheard_of"] == 0).all()
    assert calendar.latest_rows(gappy_bars, 3).count() == 4 * 3 + 1


def dealt_to_dates(df) -> int:
    """The most columns that a shuffle by date carries."""
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return max(int(n) for n in re.findall(r"\) Exchange\nInput \[(\d+)\]: .*\nArguments: hashpartitioning\(trade_date", text))


def test_wide_rows_are_not_dealt_to_the_dates(gappy_bars, monkeypatch):
    names = features.preset_features(gappy_bars.columns, "alpha")
    unkeyed = gappy_bars.limit(3).withColumn("stock_id", F.lit(None).cast("string"))
    bars = gappy_bars.unionByName(unkeyed).unionByName(gappy_bars.limit(1).withColumn("trade_date", F.lit(None).cast("date")))
    sort = lambda df: df.toPandas().sort_values([*KEY, "open"]).reset_index(drop=True)
    made = features.build_features(bars, "alpha", max_history_rows=7)
    ranks = sum(n.endswith("_cs_rank") for n in names)
    assert dealt_to_dates(features.build_features(bars, "alpha")) <= ranks + 5 < len(names) / 2
    monkeypatch.setattr(features, "WIDE_COLUMNS", 10_000)
    whole = features.build_features(bars, "alpha")
    assert dealt_to_dates(whole) > ranks
    pd.testing.assert_frame_equal(sort(made), sort(whole), check_exact=False, rtol=1e-9, atol=1e-9)


def test_rows_that_share_a_key_keep_their_own_ranks(gappy_bars):
    days = gappy_bars.where("stock_id = '000001'").limit(4)
    twice = gappy_bars.unionByName(days.withColumns({"close": F.col("close") * 1.5, "high": F.col("high") * 1.5}))
    made = features.build_features(twice, "alpha").toPandas()
    assert len(made) == twice.count()
    for name in ("turnover_rate", "close_return_1", "volatility_10"):
        want = made.groupby("trade_date")[name].rank(pct=True)
        filled = made[f"{name}_cs_rank"]
        assert np.allclose(filled[filled > 0], want[filled > 0])
