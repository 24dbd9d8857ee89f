"""Registered queries: every operator run on the given tables as a whole."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.functions.keys import DATE, INSTRUMENT, is_six_digit, normalized_id
from panelwright.operators import backtest, calendar, features, labels, picks, portfolio, quality, scores, splits
from panelwright.plans.shown import shown
from panelwright.sources import bars as bar_source, sinks
from panelwright.sources.adapter import load_bars
from panelwright.sources.storage import materialized, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYS = (INSTRUMENT, DATE)
NUMBERS = ("open", "close", "high", "low", "volume", "amount", "amplitude", "change_amount", "pct_chg", "turnover_rate")
WINDOWS = (3, 5, 10, 20)
# Deterministic stand-ins for model scores, one per model.
MODELS = {"ranker_a": "price_to_ma_20", "ranker_b": "close_return_5", "regressor": "volume_ratio_20"}
EQUAL = {m: 1.0 / len(MODELS) for m in MODELS}
WIDE = tuple(
    f"{n}_{w}" for w in WINDOWS for n in ("path_consistency", "win_loss_strength", "path_efficiency")
) + ("squeeze_breakout_10", "dispersion_adjusted_breakout_20", "price_position", "breakout_stability_20")
FOLDS = {"fold_count": 4, "validation_ratio": 0.1, "min_train_groups": 200, "purge_groups": 5}
NESTED = {
    "outer_folds": 4, "inner_folds": 3, "validation_ratio": 0.1, "min_train_groups": 200,
    "inner_min_train_groups": 126, "purge_groups": 5,
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- inputs derived from the given tables ---------------------------------


def stored_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars written once, for queries that read them several times."""
    return materialized(load_bars(spark, folder))


def labelled(
    spark: SparkSession, folder: str, names: list[str], keep: tuple[str, ...] = (), bars: DataFrame | None = None
) -> DataFrame:
    """Features plus forward returns on valid samples, narrow columns only."""
    bars = stored_bars(spark, folder) if bars is None else bars
    panel = features.build_features(bars, names, keep=[*KEYS, "open", *keep])
    wanted = [*KEYS, *keep, *names, "open_t_buy", "open_t_sell", "future_return"]
    return labels.valid_samples(labels.forward_returns(panel)).select(*wanted)


def scored_panel(spark: SparkSession, folder: str, bars: DataFrame | None = None) -> DataFrame:
    """Labelled rows with one score column per stand-in model and the overlay feature."""
    rows = labelled(spark, folder, list(MODELS.values()), bars=bars)
    return rows.select(*KEYS, "future_return", *[F.col(f).alias(m) for m, f in MODELS.items()], "volume_ratio_20")


def one_score(spark: SparkSession, folder: str, bars: DataFrame | None = None) -> DataFrame:
    rows = labelled(spark, folder, ["price_to_ma_20_cs_rank"], bars=bars)
    return rows.select(*KEYS, "future_return", F.col("price_to_ma_20_cs_rank").alias("pred_score"))


def fold_scores(spark: SparkSession, folder: str, bars: DataFrame | None = None) -> DataFrame:
    """Scored rows of every outer validation fold."""
    rows = materialized(scored_panel(spark, folder, bars))
    return splits.with_folds(rows, splits.purged_walk_forward(rows, **FOLDS), splits.VALID)


def fold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.model_metrics(fold_scores(spark, folder), list(MODELS), by=("fold",))


# --- sources --------------------------------------------------------------


@query
def bars(spark, folder):
    return shown(load_bars(spark, folder))


@query
def standardized_bars(spark, folder):
    """Text bars under foreign headers, with unreadable volumes on flat bars."""
    flat = F.col("high") == F.col("low")
    names = {n: aliases[-1] for n, aliases in bar_source.ALIASES.items()}
    raw = load_bars(spark, folder).select(
        F.concat(F.lit(" sh."), F.col(INSTRUMENT).cast("bigint").cast("string")).alias(" 股票代码 "),
        F.date_format(DATE, "yyyy/M/d").alias("日期"),
        *[F.col(n).cast("string").alias(names[n]) for n in ("open", "close", "high", "low", "amount", "turnover_rate")],
        F.when(flat, F.lit("n/a")).otherwise(F.col("volume").cast("string")).alias("VOLUME"),
        F.lit("x").alias("unknown"),
    )
    return shown(bar_source.standardize_bars(raw))


def raw_ids(spark, folder):
    key = F.col("s_suppkey").cast("string")
    form = F.col("s_suppkey") % 6
    text = (
        F.when(form == 0, F.concat(F.lit("  "), key, F.lit(" ")))
        .when(form == 1, F.concat(F.lit("sh."), key))
        .when(form == 2, F.concat(F.lit("SZ."), F.lpad(key, 6, "0")))
        .when(form == 3, F.concat(key, F.lit(".0")))
        .when(form == 4, F.col("s_name"))
        .otherwise(F.lit("NaN"))
    )
    return spark.read.parquet(f"{folder}/supplier.parquet").select("s_suppkey", text.alias("raw_id"))


@query
def normalized_ids(spark, folder):
    return shown(raw_ids(spark, folder).select("s_suppkey", "raw_id", normalized_id("raw_id").alias("stock_id")))


@query
def six_digit_ids(spark, folder):
    ids = raw_ids(spark, folder).select(normalized_id("raw_id").alias("stock_id"))
    good = ids.agg(F.count(F.lit(1)).alias("ids"), F.count_if(is_six_digit("stock_id")).alias("good_ids"))
    bad = quality.bad_id_count(raw_ids(spark, folder), "raw_id")
    return shown(good.withColumn("_k", F.lit(0)).join(bad.withColumn("_k", F.lit(0)), "_k").drop("_k"))


@query
def bars_round_trip(spark, folder):
    """Bars written as CSV and as Parquet by year and read back: ids keep their zeros, a missing value stays missing."""
    place = f"{shared_folder(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
    table = stored_bars(spark, folder)
    parts = []
    for fmt in ("csv", "parquet"):
        sinks.write_bars(table, f"{place}-{fmt}", fmt)
        parts.append(bar_source.read_bars(spark, f"{place}-{fmt}", fmt).withColumn("fmt", F.lit(fmt)))
    return shown(bar_source.union_histories(parts), "fmt", *KEYS, *NUMBERS)


@query
def picks_round_trip(spark, folder):
    """Picks of every date written as one CSV file, read back as text and normalised."""
    path = f"{shared_folder(spark).rstrip('/')}/picks-{uuid.uuid4().hex}"
    sinks.write_picks(picks.equal_weight_picks(one_score(spark, folder), 3).select(DATE, INSTRUMENT, "weight"), path)
    back = bar_source.read_text_table(spark, path)
    return shown(back.select(DATE, INSTRUMENT, F.col("weight").cast("double").alias("weight")))


@query
def derived_bar_fields(spark, folder):
    feed = load_bars(spark, folder).select(
        F.date_format(DATE, "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("sz."), INSTRUMENT).alias("code"),
        *[F.col(n).cast("string").alias(n) for n in ("open", "high", "low", "close", "volume", "amount")],
        F.col("turnover_rate").cast("string").alias("turn"),
        F.col("pct_chg").cast("string").alias("pctChg"),
    )
    return shown(bar_source.derive_bar_fields(feed))


@query
def union_histories(spark, folder):
    """Histories before and after the middle of the data's own range; the later ones lack a column."""
    all_bars = stored_bars(spark, folder)
    first, last = all_bars.agg(F.min(DATE), F.max(DATE)).first()
    if first is None:
        first = last = dt.date(2000, 1, 1)
    middle = first + (last - first) // 2
    after = middle + dt.timedelta(days=1)
    early, late = bar_source.split_by_dates(all_bars, (first, middle), (after, max(after, last)))
    both = bar_source.union_histories([early, late.drop("amplitude")])
    return shown(
        both.groupBy(INSTRUMENT).agg(
            F.count(F.lit(1)).alias("bars"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"),
            F.count("amplitude").alias("amplitudes"), F.sum("close").alias("close_sum"),
        )
    )


@query
def profile(spark, folder):
    return shown(bar_source.profile(load_bars(spark, folder)))


@query
def date_split(spark, folder):
    train, test = bar_source.split_by_dates(
        load_bars(spark, folder), ("1995-01-02", "1998-12-28"), ("1999-01-04", "1999-06-28")
    )
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return shown(parts, "part", *KEYS, "open", "close", "volume")


@query
def fingerprint(spark, folder):
    from panelwright.sources.sinks import fingerprint as digest

    return digest(load_bars(spark, folder).select(*KEYS, *NUMBERS), digits=9)


# --- features -------------------------------------------------------------


@query
def bar_shape(spark, folder):
    return shown(features.bar_shape(load_bars(spark, folder)), *KEYS, *features.BASE[:7], wide=WIDE)


@query
def one_step(spark, folder):
    names = [*features.BASE[7:], "vwap_proxy", "close_to_vwap"]
    return shown(features.one_step(load_bars(spark, folder)), *KEYS, *names)


@query
def typical_price_vwap(spark, folder):
    """Without an amount column the VWAP proxy is the typical price."""
    return shown(features.one_step(load_bars(spark, folder).drop("amount")), *KEYS, "vwap_proxy", "close_to_vwap", digits=9)


@query
def optional_levels(spark, folder):
    names = ["turnover_rate", "amplitude", "change_amount", "pct_chg", "log_amount"]
    return shown(features.optional_levels(load_bars(spark, folder)), *KEYS, *names)


def rolled(spark, folder):
    return features.rolling_features(features.one_step(features.bar_shape(load_bars(spark, folder))))


def per_window(*names: str) -> list[str]:
    return [f"{n}_{w}" for w in WINDOWS for n in names]


@query
def rolling_levels(spark, folder):
    names = per_window(
        "close_return", "volume_return", "price_to_ma", "volume_ratio", "amount_ratio", "high_breakout",
        "low_rebound", "range_position", "return_mean",
    )
    return shown(rolled(spark, folder), *KEYS, *names)


@query
def rolling_risk(spark, folder):
    names = per_window("volatility", "positive_day_ratio", "win_loss_strength")
    return shown(rolled(spark, folder), *KEYS, *names, wide=WIDE)


@query
def rolling_corr(spark, folder):
    panel = features.volume_correlations(features.one_step(load_bars(spark, folder)))
    return shown(panel, *KEYS, *[f"{p}_volume_corr_{w}" for w in (10, 20) for p in ("open", "close", "vwap")])


@query
def path_shape(spark, folder):
    return shown(rolled(spark, folder), *KEYS, *per_window("path_efficiency", "path_consistency"), wide=WIDE)


@query
def composites(spark, folder):
    names = ["delta_price_to_ma_10_3", "squeeze_breakout_10", "breakout_stability_20", "recovery_quality_20"]
    return shown(features.composites(rolled(spark, folder)), *KEYS, *names, wide=WIDE)


@query
def turnover_ratio(spark, folder):
    return shown(rolled(spark, folder), *KEYS, *per_window("turnover_ratio"))


@query
def market_state(spark, folder):
    return shown(features.market_state(features.instrument_features(load_bars(spark, folder), correlations=False)))


@query
def excess_features(spark, folder):
    panel = features.instrument_features(stored_bars(spark, folder), correlations=False)
    return shown(features.excess_features(panel, features.market_state(panel)), *KEYS, *features.EXCESS, wide=WIDE)


@query
def cs_rank(spark, folder):
    sources = ("close_return_1", "price_to_ma_20", "volatility_10", "open_volume_corr_20", "turnover_rate", "amplitude")
    panel = features.instrument_features(load_bars(spark, folder)).select(*KEYS, *sources)
    return shown(features.date_ranks(panel, sources), *KEYS, *[s + features.RANK_SUFFIX for s in sources])


@query
def cs_rank_split(spark, folder):
    """The same ranks with every date cut into range slices."""
    sources = ("close_return_1", "price_to_ma_20", "volatility_10", "open_volume_corr_20", "turnover_rate", "amplitude")
    panel = features.instrument_features(load_bars(spark, folder)).select(*KEYS, *sources)
    return shown(features.date_ranks(panel, sources, max_group_rows=0), *KEYS, *[s + features.RANK_SUFFIX for s in sources])


@query
def feature_panel(spark, folder):
    """The default preset: 81 features, all finite."""
    return shown(features.build_features(stored_bars(spark, folder), keep=KEYS), wide=WIDE)


@query
def full_panel(spark, folder):
    """Every feature of every family."""
    return shown(features.build_features(stored_bars(spark, folder), "full", keep=KEYS), wide=WIDE)


# --- labels ---------------------------------------------------------------


def returns_panel(spark, folder):
    return labels.valid_samples(labels.forward_returns(load_bars(spark, folder)))


@query
def forward_return(spark, folder):
    return shown(labels.forward_returns(load_bars(spark, folder)), *KEYS, "open_t_buy", "open_t_sell", "future_return")


@query
def valid_samples(spark, folder):
    return shown(returns_panel(spark, folder), *KEYS, "open_t_buy", "future_return")


@query
def clip_by_date(spark, folder):
    return shown(labels.clip_by_date(returns_panel(spark, folder), 0.05), *KEYS, "clipped_return")


@query
def clip_overall(spark, folder):
    return shown(labels.clip_overall(returns_panel(spark, folder)), *KEYS, "target")


@query
def clip_overall_sketched(spark, folder):
    """Rows per fold and role, and whether the approximate bounds cut at most half a percent of the rows more or less than 2 %."""
    panel = returns_panel(spark, folder)
    rows = splits.with_folds(panel, splits.purged_walk_forward(panel, **FOLDS))
    clipped = labels.clip_overall(rows, 0.02, group=("fold", "role"), sketch_size=4096)
    cut = {"low": F.col("target") > F.col("future_return"), "high": F.col("target") < F.col("future_return")}
    return shown(
        clipped.groupBy("fold", "role").agg(
            F.count(F.lit(1)).alias("rows"),
            *[(F.abs(F.avg(c.cast("double")) - 0.02) <= 0.005).alias(f"{n}_within") for n, c in cut.items()],
        )
    )


@query
def relevance_label(spark, folder):
    return shown(labels.relevance_labels(returns_panel(spark, folder)), *KEYS, "relevance_label")


@query
def relevance_label_clipped(spark, folder):
    return shown(labels.relevance_labels(returns_panel(spark, folder), clip_quantile=0.1), *KEYS, "relevance_label")


@query
def head_weight(spark, folder):
    weighted = labels.head_weights(returns_panel(spark, folder), quantile=0.2, weight=3.0)
    return shown(weighted, *KEYS, "sample_weight")


@query
def relevance_label_split(spark, folder):
    made = labels.relevance_labels(materialized(returns_panel(spark, folder)), max_group_rows=0)
    return shown(made, *KEYS, "relevance_label")


@query
def head_weight_split(spark, folder):
    weighted = labels.head_weights(materialized(returns_panel(spark, folder)), quantile=0.2, weight=3.0, max_group_rows=0)
    return shown(weighted, *KEYS, "sample_weight")


@query
def date_group(spark, folder):
    return shown(calendar.with_date_group(returns_panel(spark, folder)), *KEYS, "qid")


@query
def group_weights(spark, folder):
    weighted = labels.head_weights(returns_panel(spark, folder), quantile=0.2, weight=3.0)
    return shown(labels.group_weights(calendar.with_date_group(weighted)))


@query
def ranking_panel(spark, folder):
    from panelwright.plans.panels import ranking_panel as build

    names = ["price_to_ma_20", "close_return_5", "volume_ratio_20", "price_to_ma_20_cs_rank"]
    panel = build(stored_bars(spark, folder), names, head_quantile=0.2, head_weight=3.0)
    return shown(panel, *KEYS, *names, "future_return", "relevance_label", "sample_weight", "qid")


@query
def inference_panel(spark, folder):
    from panelwright.plans.panels import inference_panel as build

    names = ["price_to_ma_20", "close_return_5", "volume_ratio_20", "price_to_ma_20_cs_rank", "not_a_feature"]
    return shown(build(stored_bars(spark, folder), names), *KEYS, *names)


@query
def feature_noise(spark, folder):
    rows = labelled(spark, folder, list(MODELS.values()))
    return shown(labels.noisy_features(rows, list(MODELS.values()), fraction=0.7), *KEYS, *MODELS.values())


@query
def latest_row(spark, folder):
    return shown(calendar.latest_rows(load_bars(spark, folder)), *KEYS, "open", "close")


@query
def last_rows(spark, folder):
    return shown(calendar.latest_rows(load_bars(spark, folder), 5), *KEYS, "open", "close")


# --- splits ---------------------------------------------------------------


@query
def hold_out(spark, folder):
    return shown(splits.hold_out(load_bars(spark, folder), validation_ratio=0.1, min_train_groups=252))


@query
def walk_forward_folds(spark, folder):
    options = {k: v for k, v in FOLDS.items() if k != "purge_groups"}
    return shown(splits.walk_forward(load_bars(spark, folder), **options))


@query
def purged_folds(spark, folder):
    return shown(splits.purged_walk_forward(returns_panel(spark, folder), **FOLDS))


@query
def nested_folds(spark, folder):
    return shown(splits.nested_folds(returns_panel(spark, folder), **NESTED))


@query
def fold_rows(spark, folder):
    """Rows, dates and returns of every fold and role: the panel joined once to all folds."""
    panel = returns_panel(spark, folder)
    rows = splits.with_folds(panel, splits.purged_walk_forward(panel, **FOLDS))
    return shown(
        rows.groupBy("fold", "role").agg(
            F.count(F.lit(1)).alias("rows"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"),
            F.avg("future_return").alias("mean_return"),
        )
    )


@query
def rebalance_dates(spark, folder):
    return shown(calendar.rebalance_dates(returns_panel(spark, folder), 5))


@query
def date_membership(spark, folder):
    """Semi- and anti-join by date, semi-join by instrument."""
    panel = load_bars(spark, folder)
    chosen = calendar.rebalance_dates(panel, 5)
    latest = calendar.latest_rows(panel).where(F.col("close") > F.col("open"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.year(DATE).alias("year")).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("kind"), "year", "rows"
        )

    on = counted(calendar.on_dates(panel, chosen), "on")
    off = counted(calendar.not_on_dates(panel, chosen), "off")
    return shown(on.unionByName(off).unionByName(counted(calendar.of_instruments(panel, latest), "instrument")))


# --- scores ---------------------------------------------------------------


@query
def zscore(spark, folder):
    rows = scored_panel(spark, folder)
    per_frame = scores.zscores(rows, {m: f"z_{m}" for m in MODELS})
    both = scores.zscores(per_frame, {"ranker_a": "z_ranker_a_in_date"}, group=(DATE,))
    return shown(both, *KEYS, *[f"z_{m}" for m in MODELS], "z_ranker_a_in_date")


@query
def centred_rank(spark, folder):
    rows = scored_panel(spark, folder)
    ranked = scores.centred_ranks(rows, {m: f"c_{m}" for m in MODELS})
    return shown(ranked, *KEYS, *[f"c_{m}" for m in MODELS])


@query
def centred_rank_split(spark, folder):
    rows = materialized(scored_panel(spark, folder))
    ranked = scores.centred_ranks(rows, {m: f"c_{m}" for m in MODELS}, max_group_rows=0)
    return shown(ranked, *KEYS, *[f"c_{m}" for m in MODELS])


@query
def zscore_ensemble(spark, folder):
    return shown(scores.combine_scores(scored_panel(spark, folder), list(MODELS), "zscore_average_equal"), *KEYS, "pred_score")


@query
def rank_average(spark, folder):
    combined = scores.combine_scores(fold_scores(spark, folder), list(MODELS), "rank_average_equal", group=("fold",))
    return shown(combined, "fold", *KEYS, "pred_score")


@query
def weighted_ensemble(spark, folder):
    """Z-scores weighted by each fold's own validation metric."""
    rows = materialized(fold_scores(spark, folder))
    metrics = backtest.model_metrics(rows, list(MODELS), by=("fold",))
    weights = scores.validation_weights(metrics, group=("fold",))
    combined = scores.combine_scores(
        rows, list(MODELS), "validation_weighted_zscore_average", weights=weights, group=("fold",)
    )
    return shown(combined, "fold", *KEYS, "pred_score")


@query
def validation_weights(spark, folder):
    return shown(scores.validation_weights(fold_metrics(spark, folder), group=("fold",)))


@query
def robust_model_scores(spark, folder):
    return shown(scores.robust_model_scores(fold_metrics(spark, folder)))


@query
def shrunk_weights(spark, folder):
    """Per fold, on scores that push the best model over the cap."""
    metrics = fold_metrics(spark, folder).withColumn("score", F.col("pred_top_k_return_mean"))
    return shown(scores.shrunk_weights(metrics, shrinkage=0.2, cap=0.4, group=("fold",)))


@query
def rank_ensemble(spark, folder):
    combined = scores.rank_ensemble(scored_panel(spark, folder), list(MODELS), {"ranker_a": 0.5, "ranker_b": 0.3, "regressor": 0.2})
    return shown(combined, *KEYS, "pred_score")


@query
def rank_ensemble_split(spark, folder):
    weights = {"ranker_a": 0.5, "ranker_b": 0.3, "regressor": 0.2}
    combined = scores.rank_ensemble(materialized(scored_panel(spark, folder)), list(MODELS), weights, max_group_rows=0)
    return shown(combined, *KEYS, "pred_score")


@query
def alpha_preset_more_windows(spark, folder):
    """The alpha preset with a 60-row window on top: still its fixed 81 features."""
    panel = features.build_features(stored_bars(spark, folder), "alpha", windows=(3, 5, 10, 20, 60), keep=KEYS)
    return shown(panel, wide=WIDE)


@query
def rank_ensemble_by_date(spark, folder):
    combined = scores.rank_ensemble(scored_panel(spark, folder), list(MODELS), EQUAL, group=(DATE,))
    return shown(combined, *KEYS, "pred_score")


@query
def zscore_overlay(spark, folder):
    return shown(scores.overlay_score(scored_panel(spark, folder), "ranker_a"), *KEYS, "pred_score")


# --- picks and portfolio --------------------------------------------------


@query
def topk_picks(spark, folder):
    return shown(picks.equal_weight_picks(one_score(spark, folder), 3))


def pool_and_history(spark, folder, window: int = 60):
    """Pools of the dates with enough candidates, the closes, and all rebalance dates: the queries report the short ones."""
    stored = stored_bars(spark, folder)
    rows = materialized(one_score(spark, folder, stored))
    dates = materialized(calendar.rebalance_dates(rows, 5).select(DATE))
    history = portfolio.close_history(stored)
    pool = portfolio.candidate_pool(calendar.on_dates(rows, dates), history, window=window, on_short="skip")
    return materialized(pool), history, dates


@query
def eligible_rows(spark, folder):
    stored = stored_bars(spark, folder)
    history = portfolio.close_history(stored)
    return shown(portfolio.eligible_rows(one_score(spark, folder, stored), history), *KEYS, "pred_score", "seq")


@query
def candidate_pool(spark, folder):
    pool, _, dates = pool_and_history(spark, folder)
    return shown(portfolio.with_short_dates(pool, dates), *KEYS, "pred_score", "place", "candidates", "degraded_reason")


@query
def candidate_returns(spark, folder):
    pool, history, dates = pool_and_history(spark, folder)
    return shown(portfolio.with_short_dates(materialized(portfolio.candidate_returns(pool, history)), dates))


@query
def ledoit_wolf(spark, folder):
    pool, history, dates = pool_and_history(spark, folder)
    covariances = materialized(portfolio.shrunk_covariance(portfolio.candidate_returns(pool, history)))
    return shown(portfolio.with_short_dates(covariances, dates))


@query
def subset_search(spark, folder):
    pool, history, dates = pool_and_history(spark, folder)
    covariances = materialized(portfolio.shrunk_covariance(portfolio.candidate_returns(pool, history)))
    return shown(portfolio.with_short_dates(materialized(portfolio.subset_statistics(pool, covariances)), dates))


@query
def portfolio_selection(spark, folder):
    pool, history, dates = pool_and_history(spark, folder)
    covariances = materialized(portfolio.shrunk_covariance(portfolio.candidate_returns(pool, history)))
    chosen = portfolio.select_portfolios(pool, covariances, variance_penalties=(0.5,), correlation_penalties=(0.25,))
    return shown(portfolio.with_short_dates(materialized(portfolio.portfolio_picks(chosen)), dates))


@query
def portfolio_fallback(spark, folder):
    """Candidates need 21 closes, covariances 60 returns: the first dates with a pool fall back to the best five."""
    pool, history, dates = pool_and_history(spark, folder, window=20)
    covariances = materialized(portfolio.shrunk_covariance(portfolio.candidate_returns(pool, history)))
    chosen = portfolio.select_portfolios(pool, covariances, variance_penalties=(0.25,), correlation_penalties=(0.1,))
    columns = (DATE, "stock_ids", "portfolio_variance", "selection_score", "degraded_reason")
    return shown(portfolio.with_short_dates(materialized(chosen), dates), *columns)


@query
def portfolio_series(spark, folder):
    stored = stored_bars(spark, folder)
    series = backtest.portfolio_series(
        one_score(spark, folder, stored), stored, variance_penalties=(0.25,), correlation_penalties=(0.1,),
        on_short="report",
    )
    return shown(series)


@query
def risk_grid(spark, folder):
    stored = stored_bars(spark, folder)
    return shown(backtest.parameter_grid(one_score(spark, folder, stored), stored, on_short="report"))


@query
def risk_choice(spark, folder):
    stored = stored_bars(spark, folder)
    board = backtest.parameter_grid(one_score(spark, folder, stored), stored, on_short="report")
    return shown(backtest.select_risk_configuration(board))


def fold_boards(spark, folder):
    stored = stored_bars(spark, folder)
    rows = scores.rank_ensemble(fold_scores(spark, folder, stored), list(MODELS), EQUAL, group=("fold",))
    return backtest.parameter_grid(rows, stored, by=("fold",), on_short="report")


@query
def fold_risk_boards(spark, folder):
    """One leaderboard per outer fold, all folds in one job."""
    return shown(fold_boards(spark, folder), "fold", *backtest.PENALTIES, "week_count", "mean", "cvar10", "robust_score", "rank")


@query
def final_risk(spark, folder):
    return shown(backtest.select_final_configuration(fold_boards(spark, folder)))


# --- metrics and gates ----------------------------------------------------


@query
def topk_metrics(spark, folder):
    return shown(backtest.top_k_metrics(one_score(spark, folder)))


@query
def weekly_stats(spark, folder):
    """Statistics of the mean return of each date, per year."""
    weekly = returns_panel(spark, folder).groupBy(DATE).agg(F.avg("future_return").alias("weekly_return"))
    yearly = weekly.withColumn("year", F.year(DATE))
    return shown(backtest.weekly_statistics(yearly, "weekly_return", by=("year",)))


@query
def model_evaluation(spark, folder):
    return shown(fold_metrics(spark, folder))


@query
def fold_summary(spark, folder):
    return shown(backtest.summarize_fold_metrics(fold_metrics(spark, folder)))


def compared(spark, folder):
    from panelwright.plans.training import compare_strategies

    return compare_strategies(fold_scores(spark, folder), list(MODELS), main="ranker_a")


@query
def strategy_comparison(spark, folder):
    return shown(compared(spark, folder))


@query
def backtest_gates(spark, folder):
    rows = compared(spark, folder).withColumn("purge_group_count", F.lit(FOLDS["purge_groups"]))
    return shown(backtest.backtest_gates(rows, strategy="equal_rank_top5"))


def latest_picks(spark, folder):
    """The five most traded instruments of the last date with at least eight of them."""
    panel = load_bars(spark, folder)
    busy = panel.groupBy(DATE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 8).agg(F.max(DATE).alias(DATE))
    day = panel.join(F.broadcast(busy), DATE)
    return picks.equal_weight_picks(day.withColumn("pred_score", F.col("volume")), 5).select(INSTRUMENT, "weight")


@query
def picks_check(spark, folder):
    report = picks.picks_report(
        latest_picks(spark, folder), exact_positions=5, exact_weight=0.2, allowed=load_bars(spark, folder)
    )
    return shown(report)


@query
def normalized_inputs(spark, folder):
    """Pick list and scoring bars under the foreign headers, with unreadable prices dropped."""
    chosen = picks.normalized_picks(latest_picks(spark, folder).toDF("股票代码", "权重"))
    raw = load_bars(spark, folder).select(
        F.col(INSTRUMENT).cast("bigint").cast("string").alias("股票代码"), F.col(DATE).alias("日期"),
        F.when(F.col("volume") > 10, F.col("open").cast("string")).otherwise("-").alias("开盘"),
        F.col("close").alias("收盘"),
    )
    clean = picks.normalized_score_bars(raw)
    return shown(
        clean.join(chosen, INSTRUMENT, "left").groupBy(INSTRUMENT).agg(
            F.count(F.lit(1)).alias("bars"), F.max("weight").alias("weight"), F.sum("open").alias("open_sum")
        )
    )


@query
def realised_score(spark, folder):
    return shown(picks.realised_score(latest_picks(spark, folder), load_bars(spark, folder)))


@query
def score_vs_baseline(spark, folder):
    current = latest_picks(spark, folder)
    panel = load_bars(spark, folder)
    dearest = calendar.latest_rows(panel).withColumns({"pred_score": F.col("close"), "all": F.lit(0)})
    baseline = picks.equal_weight_picks(dearest, 5, by=("all",)).select(INSTRUMENT, "weight")
    return shown(picks.compare_scores(current, baseline, panel))


@query
def quality_report(spark, folder):
    report = quality.quality_report(load_bars(spark, folder), dt.date(2001, 10, 29), minimum_stock_count=5)
    return shown(report)


@query
def quality_of_lines(spark, folder):
    """Raw order lines as bars: copies of keys, unreadable dates, broken price ranges."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    flawed = lines.select(
        F.col("l_suppkey").cast("string").alias("stock_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("soon")).otherwise(F.col("l_shipdate").cast("string")).alias("trade_date"),
        F.col("l_extendedprice").alias("open"),
        F.when(F.col("l_quantity") > 1, F.col("l_extendedprice")).alias("close"),
        (F.col("l_extendedprice") * (F.lit(1.05) - F.col("l_discount"))).alias("high"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_tax"))).alias("low"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("volume"),
    )
    return shown(quality.quality_report(flawed, dt.date(2001, 10, 29)))


# --- ranking objective -------------------------------------------------------


def ranked_rows(spark, folder):
    """(qid, id, relevance_label, score) of the labelled rows."""
    rows = calendar.with_date_group(labels.relevance_labels(materialized(one_score(spark, folder))))
    return materialized(rows.select("qid", "stock_id", "relevance_label", F.col("pred_score").alias("score")))


@query
def ranker_ideal_gain(spark, folder):
    from panelwright.operators import models

    return shown(models.ideal_gain(ranked_rows(spark, folder), 30), "qid", "ideal")


@query
def ranker_ndcg(spark, folder):
    from panelwright.operators import models

    return shown(models.ndcg(ranked_rows(spark, folder), 5))


@query
def ranker_gradients(spark, folder):
    """Pull and curvature of the ranking loss on every row."""
    from panelwright.operators import models

    rows = ranked_rows(spark, folder)
    found = models.rank_gradients(rows, models.ideal_gain(rows, 30), truncation=30)
    return shown(found, "qid", "stock_id", "gradient", "curvature")


# --- models: all features, folds and rounds of the defaults; trees have no SQL, so tests check them ---------

TRAINING_FOLDS = {"min_train_groups": FOLDS["min_train_groups"]}


def training_rows(spark, folder) -> tuple[DataFrame, list[str]]:
    """The ranking panel of the default preset and its feature names."""
    from panelwright.config import DEFAULTS
    from panelwright.plans.panels import ranking_panel as build

    bars = stored_bars(spark, folder)
    names = features.preset_features(bars.columns, DEFAULTS.feature_preset, DEFAULTS.feature_windows)
    return materialized(build(bars, names)), names


def scored_by(spark, folder, name: str) -> DataFrame:
    """Fit on the training dates of the hold-out split and score its validation dates."""
    from panelwright.operators import models

    rows, names = training_rows(spark, folder)
    roles = splits.hold_out(rows, validation_ratio=0.1, min_train_groups=252)
    train = splits.with_folds(rows, roles, splits.TRAIN)
    fitted = models.fit_models(train, names, names=[name])
    valid = splits.with_folds(rows, roles, splits.VALID)
    return models.predict_all(valid, fitted).select(*KEYS, "future_return", "relevance_label", "qid", name)


@query
def gbt_scores(spark, folder):
    return scored_by(spark, folder, "regressor")


@query
def ranker_a_scores(spark, folder):
    return scored_by(spark, folder, "ranker_a")


@query
def ranker_b_scores(spark, folder):
    return scored_by(spark, folder, "ranker_b")


@query
def feature_importance(spark, folder):
    from panelwright.operators import models

    rows, names = training_rows(spark, folder)
    return models.feature_importance(spark, models.fit_ranker(rows, names))


@query
def inner_selection(spark, folder):
    """Weights and penalties chosen on the nested folds: four outer, three inner."""
    from dataclasses import replace

    from panelwright.config import DEFAULTS
    from panelwright.plans.training import inner_selection as choose

    rows, names = training_rows(spark, folder)
    chosen = choose(rows, load_bars(spark, folder), names, config=replace(DEFAULTS, **TRAINING_FOLDS), on_short="report")
    return chosen.weights.join(chosen.risk, "outer_fold")


@query
def training_run(spark, folder):
    """Figures per outer fold and strategy of the whole training: default features, 4 x 3 folds, full profiles."""
    from dataclasses import replace

    from panelwright.config import DEFAULTS
    from panelwright.plans.training import train

    config = replace(DEFAULTS, **TRAINING_FOLDS)
    return train(stored_bars(spark, folder), config=config, on_short="report").reports["strategies"]


@query
def inference_run(spark, folder):
    """The picks of the latest date by the production model, fitted on all dates, saved and loaded again."""
    from panelwright.operators import models
    from panelwright.plans.inference import infer
    from panelwright.sources import model_store
    from panelwright.sources.storage import shared_folder

    bars = stored_bars(spark, folder)
    rows, names = training_rows(spark, folder)
    fitted = models.fit_models(rows, names, names=[models.RANKER_A])
    metadata = model_store.production_metadata(features=names, weights={models.RANKER_A: 1.0}, method=model_store.SINGLE)
    path = f"{shared_folder(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    model_store.save_models(spark, path, fitted, metadata)
    return infer(bars, *model_store.load_models(spark, path)).picks
