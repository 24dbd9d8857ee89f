"""The range-partitioned path must give what a window gives."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import features, labels, ordering
from panelwright.operators.features import market_state

KEY = ["stock_id", "trade_date"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for d in range(6):
        for s in range(40 if d else 400):  # one hot date
            x = None if rng.random() < 0.1 else float(rng.choice([0.0, 0.0, 0.0, -0.0, rng.randint(-5, 5), rng.random()]))
            rows.append((f"{s:06d}", d, x, rng.random()))
    # Copies of keys, a NULL date and NULL ids must rank alike on both paths.
    rows += [rows[5], rows[5], rows[450], ("000001", None, 1.0, 0.4), (None, None, 2.0, 0.7), (None, 1, 3.0, 0.9), ("000001", None, None, 0.1)]
    return spark.createDataFrame(rows, "stock_id string, trade_date int, x double, y double").cache()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).toPandas().round(9).astype(object).where(lambda p: p.notna(), None).values), key=str)


@pytest.mark.parametrize("missing", ["exclude", "lowest"])
@pytest.mark.parametrize("group", [["trade_date"], []])
def test_ranks_agree(table, missing, group):
    args = (table, group, {"x": "rx", "y": "ry"})
    small = ordering.fractional_ranks(*args, missing=missing, in_window=True)
    large = ordering.fractional_ranks(*args, missing=missing, in_window=False)
    assert rows(small, *KEY, "rx", "ry") == rows(large, *KEY, "rx", "ry")


def test_ranks_match_pandas(table):
    ranked = ordering.fractional_ranks(table, ["trade_date"], {"x": "rx"}, in_window=True).toPandas()
    expected = ranked.groupby("trade_date", dropna=False)["x"].rank(pct=True)
    assert np.allclose(ranked["rx"].astype(float), expected, equal_nan=True)


def test_hot_values_are_joined_by_broadcast(table, monkeypatch):
    monkeypatch.setattr(ordering, "HOT_VALUE_ROWS", 20)
    monkeypatch.setattr(ordering, "HOT_VALUES_MAX", 1_000_000)
    args = (table, ["trade_date"], {"x": "rx"})
    small = ordering.fractional_ranks(*args, in_window=True)
    assert rows(small, *KEY, "rx") == rows(ordering.fractional_ranks(*args, in_window=False), *KEY, "rx")


@pytest.mark.parametrize("group", [["trade_date"], []])
def test_quantiles_agree(table, group):
    wanted = {"lo": 0.1, "mid": 0.5, "hi": 0.93}
    small = ordering.group_quantiles(table, group, "x", wanted, in_window=True)
    large = ordering.group_quantiles(table, group, "x", wanted, in_window=False)
    assert rows(small, *group, *wanted) == rows(large, *group, *wanted)
    if not group:
        values = [r.x for r in table.collect() if r.x is not None]
        assert large.first()["hi"] == pytest.approx(np.quantile(values, 0.93))


def test_positions_agree(table):
    order = [F.col("y").desc(), F.col("stock_id")]
    small = ordering.positions(table, ["trade_date"], order, "p", in_window=True)
    large = ordering.positions(table, ["trade_date"], order, "p", in_window=False)
    assert rows(small, *KEY, "p") == rows(large, *KEY, "p")


def test_large_dates_give_the_same_features_and_labels(gappy_bars):
    wanted = ["price_to_ma_5_cs_rank", "turnover_rate_cs_rank", "market_top_decile_return_1", "market_amount_top_share_1"]
    small = features.build_features(gappy_bars, wanted, keep=KEY)
    large = features.build_features(gappy_bars, wanted, keep=KEY, max_group_rows=0)
    assert rows(small, *KEY, *wanted) == rows(large, *KEY, *wanted)
    panel = labels.valid_samples(labels.forward_returns(gappy_bars))
    for limit in (None, 0):
        made = labels.relevance_labels(panel, clip_quantile=0.1, max_group_rows=limit)
        made = labels.clip_overall(labels.head_weights(made, quantile=0.4, weight=2.0, max_group_rows=limit), 0.1, max_group_rows=limit)
        found = rows(made, *KEY, "relevance_label", "sample_weight", "target")
        first = found if limit is None else first
        assert found == first


def test_market_state_of_large_dates(gappy_bars):
    panel = features.instrument_features(gappy_bars)
    small, large = market_state(panel), market_state(panel, max_group_rows=0)
    assert rows(small, *sorted(small.columns)) == rows(large, *sorted(small.columns))


def test_copied_keys_and_null_dates_keep_their_rows(spark):
    data = [("a", 1, 0.5), ("b", 1, 0.1), ("a", 1, 0.5), ("a", 1, -0.2), ("c", 1, 0.9), ("d", None, 0.3), ("e", None, 0.2), (None, 1, 0.0)]
    panel = spark.createDataFrame(data, "stock_id string, trade_date int, future_return double")
    found = []
    for limit in (None, 0):
        made = labels.relevance_labels(labels.head_weights(panel, quantile=0.3, weight=2.0, max_group_rows=limit), max_group_rows=limit)
        found.append(rows(made, *KEY, "future_return", "relevance_label", "sample_weight"))
    assert len(found[0]) == len(data) and found[0] == found[1]


def test_long_histories_are_cut_into_overlapping_slices(gappy_bars):
    wanted = ["price_to_ma_20", "volatility_10", "delta_price_to_ma_10_3", "open_volume_corr_20", "close_return_1_cs_rank"]
    whole = features.build_features(gappy_bars, wanted, keep=KEY)
    cut = features.build_features(gappy_bars, wanted, keep=KEY, max_history_rows=7)
    assert rows(whole, *KEY, *wanted) == rows(cut, *KEY, *wanted)
    labelled = [labels.forward_returns(gappy_bars, max_group_rows=n) for n in (None, 2, 9)]
    first = rows(labelled[0], *KEY, "future_return", "open_t_buy")
    assert all(rows(x, *KEY, "future_return", "open_t_buy") == first for x in labelled[1:])


def test_sketched_clip_is_close_in_rank(spark):
    """10 000 and 300 rows of two folds, a fold without values: ranks of the bounds against exact ones."""
    data = [(n % 2 if n < 600 else 0, float((n * 7919) % 10301)) for n in range(10300)] + [(2, None), (None, 4.0)]
    panel = spark.createDataFrame(data, "fold int, future_return double").repartition(5)
    out = labels.clip_overall(panel, 0.05, group=("fold",), sketch_size=2048).where("fold IS NOT NULL").collect()
    for fold in (0, 1):
        own = [r for r in out if r.fold == fold]
        for cut in (sum(r.target > r.future_return for r in own), sum(r.target < r.future_return for r in own)):
            assert abs(cut / len(own) - 0.05) < 0.008
    assert [r.target for r in out if r.fold == 2] == [None] and len(out) == len(data) - 1
    exact = labels.clip_overall(panel.where("fold = 0"), 0.05)
    assert exact.count() == sum(f == 0 for f, _ in data)
    assert labels.clip_overall(panel.limit(0), 0.05, sketch_size=64).count() == 0


def test_split_ranks_deal_the_values_once(table, monkeypatch):
    stored, write = [], ordering.materialized
    monkeypatch.setattr(ordering, "materialized", lambda df: stored.append(df) or write(df))
    made = ordering.fractional_ranks(table, ["trade_date"], {"x": "rx", "y": "ry"}, in_window=False)
    mode = table.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plans = [df._jdf.queryExecution().explainString(mode) for df in [*stored, made]]
    dealt = [re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan) for plan in plans]
    assert sum("_value" in columns for found in dealt for columns in found) == 1


def test_steps_never_fall_while_values_rise(spark):
    rng = random.Random(5)
    ends = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), 1.0, 1.0 + 2**-52, 1.0 - 2**-53]
    numbers = ends + [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1074, 1023) for _ in range(3000)] + [rng.gauss(0, 1) for _ in range(3000)]
    made = spark.createDataFrame([(x,) for x in sorted(numbers)], "v double").withColumn("step", ordering._step_of("v")).toPandas()
    made = made.sort_values("v", kind="stable")
    assert (np.diff(made["step"]) >= 0).all() and made["step"].nunique() > 5900
