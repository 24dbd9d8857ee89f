import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright.operators import calendar, labels, splits
from panelwright.plans.panels import ranking_panel, require_samples
from tests.conftest import business_days

OPTIONS = {"fold_count": 2, "validation_ratio": 0.2, "min_train_groups": 10, "purge_groups": 5}


def test_purge_leaves_more_than_five_dates(scored):
    dates = business_days("2026-01-01", 40)
    folds = splits.purged_walk_forward(scored(), **OPTIONS).toPandas()
    assert sorted(folds["fold"].unique()) == [0, 1]
    for _, fold in folds.groupby("fold"):
        last = dates.index(fold[fold.role == "train"]["trade_date"].max())
        first = dates.index(fold[fold.role == "valid"]["trade_date"].min())
        assert first - last > 5
        assert (fold.role == "valid").sum() == 8


def test_bad_parameters_fail(scored):
    for change in ({"fold_count": 0}, {"validation_ratio": 1.0}, {"min_train_groups": 0}, {"purge_groups": -1}):
        with pytest.raises(ValueError):
            splits.purged_walk_forward(scored(), **{**OPTIONS, **change})
    with pytest.raises(PySparkException, match="too short for one purged fold"):
        splits.purged_walk_forward(scored(), **{**OPTIONS, "min_train_groups": 100}).collect()
    with pytest.raises(PySparkException, match="too few dates"):
        splits.hold_out(scored(), validation_ratio=0.1, min_train_groups=40).collect()


def test_nested_folds_stay_inside_the_outer_training_range(scored):
    nested = splits.nested_folds(
        scored(), outer_folds=2, inner_folds=2, validation_ratio=0.2, min_train_groups=15, inner_min_train_groups=5,
        purge_groups=2,
    ).toPandas()
    outer = splits.purged_walk_forward(scored(), **{**OPTIONS, "min_train_groups": 15, "purge_groups": 2}).toPandas()
    for fold, part in nested.groupby("outer_fold"):
        train = outer[(outer.fold == fold) & (outer.role == "train")]
        assert part["trade_date"].max() <= train["trade_date"].max()
        assert part["inner_fold"].nunique() == 2


def test_rebalance_dates(scored):
    dates = [r.trade_date for r in calendar.rebalance_dates(scored(), 5).orderBy("trade_date").collect()]
    assert dates == business_days("2026-01-01", 40)[::5]
    with pytest.raises(ValueError):
        calendar.rebalance_dates(scored(), 0)


def test_labels_weights_and_groups(scored):
    panel = labels.head_weights(labels.relevance_labels(scored(10), buckets=3), quantile=0.34, weight=2.0)
    one = panel.where(F.col("trade_date") == F.lit(business_days("2026-01-01", 1)[0])).orderBy("stock_id").collect()
    # Places from the best: 6..1 of 6, so (1 - place/6) * 3 = 0, .5, 1, 1.5, 2, 2.5.
    assert [r.relevance_label for r in one] == [0, 0, 1, 1, 2, 2]
    assert [r.sample_weight for r in one] == [1, 1, 1, 1, 2, 2]
    groups = labels.group_weights(calendar.with_date_group(panel)).orderBy("qid").collect()
    assert [g.qid for g in groups] == list(range(10)) and groups[0].group_size == 6
    assert groups[0].group_weight == pytest.approx(8 / 6)


def test_forward_return_counts_rows(gappy_bars):
    panel = labels.forward_returns(gappy_bars).where(F.col("stock_id") == "000001").orderBy("trade_date").collect()
    assert panel[5].open_t_buy == panel[6].open and panel[5].open_t_sell == panel[10].open
    assert panel[-1].future_return is None


def test_empty_ranking_panel_is_explained(gappy_bars):
    short = gappy_bars.where(F.col("trade_date") <= F.lit(business_days("2026-01-05", 4)[-1]))
    with pytest.raises(ValueError, match="no labelled rows"):
        require_samples(ranking_panel(short, ["price_to_ma_5"]), short)


def test_noise_is_keyed_and_partial(gappy_bars):
    names = ["open", "close", "high", "low", "volume"]
    once = labels.noisy_features(gappy_bars, names, seed=1, fraction=0.5)
    again = labels.noisy_features(gappy_bars.repartition(5), names, seed=1, fraction=0.5)
    order = ["stock_id", "trade_date"]
    first, second = (d.select(*order, *names).orderBy(*order).toPandas() for d in (once, again))
    assert np.allclose(first[names], second[names], rtol=1e-12)
    both = once.select(*order, *[F.col(n).alias("n_" + n) for n in names]).join(gappy_bars, order).toPandas()
    changed = [n for n in names if (both[n] != both["n_" + n]).any()]
    assert 0 < len(changed) < len(names)
    spread = (both["n_" + changed[0]] - both[changed[0]]).std()
    assert 0 < spread < 0.05 * both[changed[0]].std()
