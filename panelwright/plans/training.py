"""Nested walk-forward training, evaluation and the final fit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelwright.config import DEFAULTS, PanelConfig
from panelwright.functions.keys import DATE, INSTRUMENT
from panelwright.operators import backtest, features, scores, splits
from panelwright.operators.models import (
    MODEL_NAMES,
    PROFILES,
    RANKER_A,
    BoostProfile,
    Fitted,
    feature_importance,
    fit_many,
    model_fits,
    predict_folds,
)
from panelwright.plans.panels import ranking_panel, require_samples
from panelwright.sources.bars import profile
from panelwright.sources.model_store import EQUAL_RANK, SINGLE, data_stamp, production_metadata
from panelwright.sources.storage import materialized

OVERLAY, SINGLE_TOP, EQUAL_TOP, RISK_TOP = "overlay_top1", "ranker_top5", "equal_rank_top5", "risk_controlled_top5"


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def compare_strategies(
    fold_rows: DataFrame,
    models: Sequence[str] = MODEL_NAMES,
    *,
    main: str = RANKER_A,
    config: PanelConfig = DEFAULTS,
    risk_statistics: DataFrame | None = None,
    by: Sequence[str] = ("fold",),
) -> DataFrame:
    """Metrics per fold and strategy: overlay top 1, main model, equal-rank ensemble, risk-controlled.

    ``risk_statistics`` (weekly statistics per fold) fills the last strategy;
    figures it does not have stay NULL.
    """
    narrow = [*by, DATE, INSTRUMENT, "future_return", "pred_score"]
    overlay = scores.overlay_score(
        fold_rows, main, feature=config.overlay_feature, weight=config.overlay_weight, group=by
    ).select(*narrow)
    single = fold_rows.withColumn("pred_score", F.col(main)).select(*narrow)
    equal = scores.rank_ensemble(
        fold_rows, list(models), {m: 1.0 / len(models) for m in models}, group=by, max_group_rows=config.max_group_rows
    ).select(*narrow)
    keys = [*by, "strategy"]
    first = backtest.top_k_metrics(
        overlay.withColumn("strategy", F.lit(OVERLAY)), k=1, stride=config.rebalance_stride, by=keys
    )
    rest = backtest.top_k_metrics(
        single.withColumn("strategy", F.lit(SINGLE_TOP)).unionByName(equal.withColumn("strategy", F.lit(EQUAL_TOP))),
        k=config.top_k, stride=config.rebalance_stride, by=keys,
    )
    table = first.unionByName(rest)
    if risk_statistics is None:
        return table
    names = {
        "pred_top_k_return_mean": "mean", "pred_top_k_return_median": "median", "pred_top_k_return_std": "std",
        "pred_top_k_positive_rate": "positive_rate", "pred_top_k_q10": "q10", "pred_top_k_cvar10": "cvar10",
        "pred_top_k_worst": "worst", "baseline_top_k_return_mean": "baseline_mean",
        "evaluated_week_count": "week_count",
    }
    risk = risk_statistics.select(
        *by, F.lit(RISK_TOP).alias("strategy"), *[F.col(s).alias(n) for n, s in names.items()]
    )
    return table.unionByName(risk, allowMissingColumns=True)


@dataclass
class Selection:
    """What the inner folds of every outer fold decide."""

    weights: DataFrame  # outer_fold, model, weight
    risk: DataFrame  # outer_fold, penalties
    metrics: DataFrame  # outer_fold, inner_fold, model, metrics
    robust_scores: DataFrame  # outer_fold, model, score
    leaderboard: DataFrame  # outer_fold, penalties, statistics, rank


@dataclass(frozen=True)
class Ranges:
    """Training ranges under numbers: those of a fold table by their keys, and the whole panel."""

    dates: DataFrame  # date, fold (the number)
    numbers: dict[str, dict[tuple, int]]


def training_ranges(panel: DataFrame, tables: dict[str, tuple[DataFrame, Sequence[str]]], *, whole: bool = False) -> Ranges:
    """The training dates of every fold of the named tables, and of the whole panel, numbered from 0."""
    spark, parts, numbers, count = panel.sparkSession, [], {}, 0
    for name, (table, keys) in tables.items():
        rows = table.select(*keys).distinct().orderBy(*keys).collect()  # one row per fold
        numbers[name] = {tuple(r): count + n for n, r in enumerate(rows)}
        named = spark.createDataFrame([(*k, n) for k, n in numbers[name].items()], ", ".join([*[f"{k} int" for k in keys], "_number int"]))
        train = table.where(F.col("role") == splits.TRAIN)
        parts.append(train.join(F.broadcast(named), list(keys)).select(DATE, F.col("_number").alias("fold")))
        count += len(rows)
    if whole:
        numbers["whole"] = {(): count}
        parts.append(panel.select(DATE).distinct().withColumn("fold", F.lit(count)))
    return Ranges(materialized(_union(parts)), numbers)


def fit_ranges(
    panel: DataFrame, ranges: Ranges, names: Sequence[str], *, profiles: dict[str, BoostProfile], config: PanelConfig,
    whole: Sequence[str] = MODEL_NAMES, state_folder: str | None = None,
) -> dict[int, dict[str, Fitted]]:
    """The models of every training range by its number; all fits advance together. ``whole`` names those of the whole panel."""
    last = ranges.numbers.get("whole", {}).get(())
    folds = sorted(n for held in ranges.numbers.values() for n in held.values() if n != last)
    fits = model_fits(folds, profiles, config.seed)
    if last is not None:
        fits += model_fits([last], profiles, config.seed, whole)
    made = fit_many(
        panel, fits, names, folds=ranges.dates, noise_std=config.noise_std, noise_fraction=config.noise_fraction,
        clip_quantile=config.target_clip_quantile, max_group_rows=config.max_group_rows, state_folder=state_folder,
    )
    out: dict[int, dict[str, Fitted]] = {}
    for fit, fitted in zip(fits, made, strict=True):
        out.setdefault(fit.fold, {})[fit.name] = fitted
    return out


def scored_folds(
    panel: DataFrame, table: DataFrame, keys: Sequence[str], numbers: dict[tuple, int], models: dict[int, dict[str, Fitted]], config: PanelConfig
) -> DataFrame:
    """Validation rows of every fold of the table with the scores of the models fitted on its training rows, in one job."""
    carried = [*keys, DATE, INSTRUMENT, "future_return", *_overlay_columns(panel, config)]
    named = panel.sparkSession.createDataFrame([(*k, n) for k, n in numbers.items()], ", ".join([*[f"{k} int" for k in keys], "_number int"]))
    valid = splits.with_folds(panel, table, splits.VALID).join(F.broadcast(named), list(keys))
    by_name = {m: {n: models[n][m] for n in numbers.values()} for m in MODEL_NAMES}
    return materialized(predict_folds(valid, by_name, F.col("_number")).select(*carried, *MODEL_NAMES))


def _overlay_columns(panel: DataFrame, config: PanelConfig) -> list[str]:
    return [config.overlay_feature] if config.overlay_feature in panel.columns else []


def nested_ranges(panel: DataFrame, config: PanelConfig) -> DataFrame:
    return materialized(
        splits.nested_folds(
            panel, outer_folds=config.outer_folds, inner_folds=config.inner_folds,
            validation_ratio=config.validation_ratio, min_train_groups=config.min_train_groups,
            inner_min_train_groups=config.inner_min_train_groups, purge_groups=config.purge_groups,
        )
    )


def inner_selection(
    panel: DataFrame,
    bars: DataFrame,
    names: Sequence[str],
    *,
    profiles: dict[str, BoostProfile] = PROFILES,
    config: PanelConfig = DEFAULTS,
    on_short: str = "error",
    nested: DataFrame | None = None,
    rows: DataFrame | None = None,
    state_folder: str | None = None,
) -> Selection:
    """Model weights and risk penalties of every outer fold, chosen on its inner folds.

    ``rows`` are the scored validation rows of the folds ``nested``; without them the models are fitted here.
    """
    fold = ("outer_fold", "inner_fold")
    if rows is None:
        nested = nested_ranges(panel, config)
        ranges = training_ranges(panel, {"inner": (nested, fold)})
        models = fit_ranges(panel, ranges, names, profiles=profiles, config=config, state_folder=state_folder)
        rows = scored_folds(panel, nested, fold, ranges.numbers["inner"], models, config)
    metrics = materialized(
        backtest.model_metrics(rows, MODEL_NAMES, k=config.top_k, stride=config.rebalance_stride, by=fold)
    )
    robust = scores.robust_model_scores(metrics, group=("outer_fold",))
    weights = materialized(
        scores.shrunk_weights(
            robust, shrinkage=config.weight_shrinkage, cap=config.weight_cap, group=("outer_fold",)
        )
    )
    # Ranks are taken inside each inner fold with the weights of its outer fold.
    per_inner = weights.join(F.broadcast(nested.select(*fold).distinct()), "outer_fold")
    ranked = scores.rank_ensemble(rows, MODEL_NAMES, per_inner, group=fold, max_group_rows=config.max_group_rows)
    # The inner validation ranges follow each other, so their union is one series per outer fold.
    board = materialized(
        backtest.parameter_grid(
            ranked, bars, variance_penalties=config.variance_penalties,
            correlation_penalties=config.correlation_penalties, cvar_penalties=config.cvar_penalties,
            pool=config.candidate_pool, window=config.covariance_window, stride=config.rebalance_stride,
            k=config.top_k, by=("outer_fold",), on_short=on_short,
        )
    )
    risk = backtest.select_risk_configuration(board, by=("outer_fold",))
    return Selection(weights, risk, metrics, robust, board)


@dataclass
class TrainingResult:
    features: list[str]
    models: dict[str, Fitted]
    metadata: dict
    reports: dict[str, DataFrame] = field(default_factory=dict)


def train(
    bars: DataFrame,
    *,
    preset: str | Sequence[str] = DEFAULTS.feature_preset,
    profiles: dict[str, BoostProfile] = PROFILES,
    production: Sequence[str] = (RANKER_A,),
    config: PanelConfig = DEFAULTS,
    on_short: str = "error",
    state_folder: str | None = None,
) -> TrainingResult:
    """The whole run: folds, inner choices, outer evaluation, summaries and the final models.

    All models of all folds are fitted together. With a state folder, a run that was stopped goes on where it was.
    """
    if set(production) not in ({RANKER_A}, set(MODEL_NAMES)):
        raise ValueError(f"production models must be {RANKER_A} alone or all of {MODEL_NAMES}")
    names = (
        features.preset_features(bars.columns, preset, config.feature_windows)
        if isinstance(preset, str)
        else list(preset)
    )
    panel = materialized(
        ranking_panel(
            bars, names, windows=config.feature_windows, buy_offset=config.future_buy_offset,
            sell_offset=config.future_sell_offset, buckets=config.label_buckets,
            clip_quantile=config.label_clip_quantile, head_quantile=config.head_quantile,
            head_weight=config.head_weight, max_group_rows=config.max_group_rows,
        )
    )
    require_samples(panel, bars, config.future_sell_offset)
    folds = materialized(
        splits.purged_walk_forward(
            panel, fold_count=config.outer_folds, validation_ratio=config.validation_ratio,
            min_train_groups=config.min_train_groups, purge_groups=config.purge_groups,
        )
    )
    nested, fold = nested_ranges(panel, config), ("outer_fold", "inner_fold")
    ranges = training_ranges(panel, {"inner": (nested, fold), "outer": (folds, ("fold",))}, whole=True)
    fitted = fit_ranges(panel, ranges, names, profiles=profiles, config=config, whole=production, state_folder=state_folder)
    inner = inner_selection(
        panel, bars, names, profiles=profiles, config=config, on_short=on_short, nested=nested,
        rows=scored_folds(panel, nested, fold, ranges.numbers["inner"], fitted, config),
    )
    rows = scored_folds(panel, folds, ("fold",), ranges.numbers["outer"], fitted, config)
    metrics = materialized(
        backtest.model_metrics(rows, MODEL_NAMES, k=config.top_k, stride=config.rebalance_stride, by=("fold",))
    )
    weights = inner.weights.withColumnRenamed("outer_fold", "fold")
    ranked = scores.rank_ensemble(rows, MODEL_NAMES, weights, group=("fold",), max_group_rows=config.max_group_rows)
    series = materialized(
        backtest.portfolio_series(
            ranked, bars, variance_penalties=config.variance_penalties,
            correlation_penalties=config.correlation_penalties, pool=config.candidate_pool,
            window=config.covariance_window, stride=config.rebalance_stride, k=config.top_k, by=("fold",),
            on_short=on_short,
        )
    )
    statistics = backtest.series_statistics(series, by=("fold",))
    board = materialized(backtest.leaderboard(statistics, cvar_penalties=config.cvar_penalties, by=("fold",)))
    # One row per fold: the penalties its inner folds chose.
    risk = F.broadcast(inner.risk.withColumnRenamed("outer_fold", "fold").select("fold", *backtest.PENALTIES[:2]))
    on = ["fold", *backtest.PENALTIES[:2]]
    chosen = statistics.join(risk, on)
    strategies = compare_strategies(rows, MODEL_NAMES, config=config, risk_statistics=chosen).withColumn(
        "purge_group_count", F.lit(config.purge_groups)
    )
    robust = scores.robust_model_scores(metrics)

    models = fitted[ranges.numbers["whole"][()]]
    metadata = production_metadata(
        features=names, weights={name: 1.0 / len(models) for name in models},
        method=SINGLE if len(models) == 1 else EQUAL_RANK, config=config,
        preset=preset if isinstance(preset, str) else "list",
        parameters={name: asdict(profiles[name]) for name in models},
    ) | {"training_data": data_stamp(bars)}
    reports = {
        "data_profile": profile(bars),
        "training_summary": panel.agg(
            F.count(F.lit(1)).alias("row_count"), F.count_distinct(INSTRUMENT).alias("stock_count"),
            F.count_distinct(DATE).alias("date_count"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"),
        ).withColumn("feature_count", F.lit(len(names))),
        "fold_dates": folds.groupBy("fold", "role").agg(
            F.count(F.lit(1)).alias("date_count"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date")
        ),
        "inner_metrics": inner.metrics,
        "inner_weights": inner.weights,
        "inner_risk": inner.risk,
        "inner_leaderboard": inner.leaderboard,
        "model_metrics": metrics,
        "model_summary": backtest.summarize_fold_metrics(metrics),
        "robust_scores": robust,
        "diagnostic_weights": scores.shrunk_weights(
            robust, shrinkage=config.weight_shrinkage, cap=config.weight_cap
        ),
        "weekly_details": series.join(risk, on),
        "leaderboard": board,
        "final_risk": backtest.select_final_configuration(board),
        "strategies": strategies,
        **{f"importance_{name}": feature_importance(bars.sparkSession, m) for name, m in models.items()},
    }
    return TrainingResult(names, models, metadata, reports)
