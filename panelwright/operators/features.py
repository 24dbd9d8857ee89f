"""Rolling, path and cross-sectional features of a bar panel.

Per-instrument windows are row-based and short, so a history too long for one
task is cut into slices that overlap by the rows a window looks back. Everything per
date goes through ``ordering``, which splits dates too large for one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.config import DEFAULTS
from panelwright.functions.keys import DATE, INSTRUMENT
from panelwright.functions.numeric import col, ratio, simple_return, zero_filled
from panelwright.operators.calendar import broadcast_dates
from panelwright.operators.ordering import (
    MAX_GROUP_ROWS,
    fits_one_task,
    fractional_ranks,
    in_slices,
    largest_groups,
    positions,
    value_counts,
)
from panelwright.sources.storage import materialized

RANK_SUFFIX = "_cs_rank"
# Rows before a window's first one that its features still look at.
WARM_UP = 4
# From so many columns beside the ranks on, only bars and ranked values are dealt to the dates.
WIDE_COLUMNS = 32

# Feature families, presets and the columns ranked per date.
BASE = (
    "intraday_return", "high_low_range", "close_to_high", "close_to_low", "price_position",
    "upper_shadow", "lower_shadow", "open_gap_1", "close_return_1", "open_to_prev_close",
    "volume_return_1", "log_volume",
)
ROLLING = (
    "close_return", "volume_return", "return_mean", "price_to_ma", "volatility",
    "volume_ratio", "high_breakout", "low_rebound", "range_position",
)
MARKET = (
    "market_return_mean_1", "market_return_std_1", "market_up_ratio_1",
    "market_top_decile_return_1", "market_breadth_thrust_5", "market_dispersion_trend_5",
    "market_amount_top_share_1",
)
EXCESS = (
    "excess_return_1", "excess_intraday_return", "excess_price_to_ma_20", "excess_volume_ratio_5",
    "attention_gap_5", "breadth_adjusted_return_5", "dispersion_adjusted_breakout_20",
    "leader_follow_through_5", "amount_crowding_pressure_1",
)
RANKED = (
    "close_return_1", "intraday_return", "price_to_ma_5", "price_to_ma_20", "volume_ratio_5",
    "volatility_10", "close_to_vwap", "delta_price_to_ma_10_3", "open_volume_corr_20",
    "path_efficiency_10", "path_consistency_10", "excess_return_1", "excess_price_to_ma_20",
    "excess_volume_ratio_5", "breadth_adjusted_return_5", "dispersion_adjusted_breakout_20",
    "attention_gap_5", "positive_day_ratio_10", "win_loss_strength_10", "squeeze_breakout_10",
    "breakout_stability_20", "recovery_quality_20",
)
# The complete alpha preset, in its order.
ALPHA_V1 = (
    "intraday_return", "high_low_range", "close_to_high", "close_to_low", "price_position", "upper_shadow",
    "lower_shadow", "open_gap_1", "close_return_1", "open_to_prev_close", "volume_return_1", "log_volume",
    "close_to_vwap", "close_return_3", "volume_return_3", "return_mean_3", "price_to_ma_3", "volatility_3",
    "volume_ratio_3", "high_breakout_3", "low_rebound_3", "range_position_3", "close_return_5",
    "volume_return_5", "return_mean_5", "price_to_ma_5", "volatility_5", "volume_ratio_5", "high_breakout_5",
    "low_rebound_5", "range_position_5", "close_return_10", "volume_return_10", "return_mean_10",
    "price_to_ma_10", "volatility_10", "volume_ratio_10", "high_breakout_10", "low_rebound_10",
    "range_position_10", "close_return_20", "volume_return_20", "return_mean_20", "price_to_ma_20",
    "volatility_20", "volume_ratio_20", "high_breakout_20", "low_rebound_20", "range_position_20",
    "open_volume_corr_10", "close_volume_corr_10", "vwap_volume_corr_10", "open_volume_corr_20",
    "close_volume_corr_20", "vwap_volume_corr_20", "delta_price_to_ma_10_3", "close_return_1_cs_rank",
    "intraday_return_cs_rank", "price_to_ma_5_cs_rank", "price_to_ma_20_cs_rank", "volume_ratio_5_cs_rank",
    "volatility_10_cs_rank", "close_to_vwap_cs_rank", "delta_price_to_ma_10_3_cs_rank",
    "open_volume_corr_20_cs_rank", "turnover_rate", "turnover_ratio_3", "turnover_ratio_5",
    "turnover_ratio_10", "turnover_ratio_20", "turnover_rate_cs_rank", "log_amount", "amount_ratio_3",
    "amount_ratio_5", "amount_ratio_10", "amount_ratio_20", "amplitude", "amplitude_cs_rank", "change_amount",
    "pct_chg", "pct_chg_cs_rank",
)
PRESETS = {
    "baseline_v1": ("baseline_v1",),
    "alpha_v1": ("baseline_v1", "price_volume_alpha_v1"),
    "market_v1": ("baseline_v1", "market_cross_v1"),
    "path_v1": ("baseline_v1", "path_shape_v1"),
    "path_plus_v2": ("baseline_v1", "path_shape_v1", "path_shape_v2"),
    "cross_v1": ("baseline_v1", "market_cross_v1", "path_shape_v1"),
    "full_v1": (
        "baseline_v1", "price_volume_alpha_v1", "market_cross_v1", "path_shape_v1", "path_shape_v2",
    ),
}
PRESET_ALIASES = {
    "base": "baseline_v1", "baseline": "baseline_v1", "alpha": "alpha_v1", "market": "market_v1",
    "path": "path_v1", "path2": "path_plus_v2", "cross": "cross_v1", "full": "full_v1",
}
CORRELATION_WINDOWS = (10, 20)
STREAK_WINDOWS = (5, 10)


# --- which features exist -------------------------------------------------


def feature_families(
    bar_columns: Sequence[str], windows: Sequence[int] = DEFAULTS.feature_windows
) -> dict[str, list[str]]:
    """Feature names per family, in order, for the columns a bar table has."""
    have = set(bar_columns)
    corr = [w for w in windows if w in CORRELATION_WINDOWS]
    baseline = [*BASE, *[f"{name}_{w}" for w in windows for name in ROLLING]]
    alpha = ["close_to_vwap"]
    alpha += [f"{price}_volume_corr_{w}" for w in corr for price in ("open", "close", "vwap")]
    path1 = [f"{name}_{w}" for w in windows for name in ("path_efficiency", "path_consistency")]
    path2 = [
        f"{name}_{w}"
        for w in windows
        if w in STREAK_WINDOWS
        for name in ("positive_day_ratio", "win_loss_strength")
    ]
    if 10 in windows:
        alpha.append("delta_price_to_ma_10_3")
        path2.append("squeeze_breakout_10")
    if {5, 10, 20} <= set(windows):
        path2 += ["breakout_stability_20", "recovery_quality_20"]
    market = [*MARKET, *EXCESS] if "amount" in have and {5, 20} <= set(windows) else []

    families = {
        "baseline_v1": baseline,
        "price_volume_alpha_v1": alpha,
        "market_cross_v1": market,
        "path_shape_v1": path1,
        "path_shape_v2": path2,
    }
    for source in RANKED:
        home = next((names for names in families.values() if source in names), None)
        if home is not None:
            home.append(source + RANK_SUFFIX)

    if "turnover_rate" in have:
        baseline += ["turnover_rate", *[f"turnover_ratio_{w}" for w in windows], "turnover_rate" + RANK_SUFFIX]
    if "amount" in have:
        baseline += ["log_amount", *[f"amount_ratio_{w}" for w in windows]]
    if "amplitude" in have:
        baseline += ["amplitude", "amplitude" + RANK_SUFFIX]
    if "change_amount" in have:
        baseline.append("change_amount")
    if "pct_chg" in have:
        baseline += ["pct_chg", "pct_chg" + RANK_SUFFIX]
    return families


def resolve_preset(name: str) -> str:
    key = name.strip().lower()
    key = PRESET_ALIASES.get(key, key)
    if key not in PRESETS:
        raise ValueError(f"unknown feature preset {name!r}; choose one of {', '.join(sorted(PRESETS))}")
    return key


def preset_features(
    bar_columns: Sequence[str],
    preset: str = DEFAULTS.feature_preset,
    windows: Sequence[int] = DEFAULTS.feature_windows,
) -> list[str]:
    """Ordered feature columns of a preset.

    The alpha preset is its fixed list wherever the bars and windows give all of
    it; other presets, and bars without the optional columns, follow the families.
    """
    preset = resolve_preset(preset)
    families = feature_families(bar_columns, windows)
    for family in PRESETS[preset]:
        if not families[family]:
            raise ValueError(f"preset {preset} needs an amount column and the windows 5 and 20")
    names = [name for family in PRESETS[preset] for name in families[family]]
    return list(ALPHA_V1) if preset == "alpha_v1" and set(ALPHA_V1) <= set(names) else names


# --- per-instrument windows ----------------------------------------------


def _history():
    return Window.partitionBy(INSTRUMENT).orderBy(DATE)


def _rolling(rows: int):
    return _history().rowsBetween(1 - rows, Window.currentRow)


def _earlier(name: str, rows: int = 1) -> Column:
    return F.lag(name, rows).over(_history())


def bar_shape(bars: DataFrame) -> DataFrame:
    """Shape of a single bar; no window needed."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.withColumns(
        {
            "intraday_return": ratio(c, o) - 1.0,
            "high_low_range": ratio(h - l, o),
            "close_to_high": ratio(c, h) - 1.0,
            "close_to_low": ratio(c, l) - 1.0,
            "price_position": ratio(c - l, h - l),
            "upper_shadow": ratio(h - F.greatest(o, c), o),
            "lower_shadow": ratio(F.least(o, c) - l, o),
        }
    )


def vwap_proxy(columns: Sequence[str]) -> Column:
    if "amount" in columns:
        return ratio("amount", "volume")
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / F.lit(4.0)


def one_step(bars: DataFrame) -> DataFrame:
    """Changes against the previous row of the instrument; the first row gives 0."""

    def change(name: str) -> Column:
        before = _earlier(name)
        both_zero = (before == 0) & (F.col(name) == 0)
        # A jump from zero has no finite return and stays missing in the rolling windows.
        return F.when(before.isNull() | both_zero, F.lit(0.0)).otherwise(simple_return(F.col(name), before))

    return bars.withColumns(
        {
            "open_gap_1": change("open"),
            "close_return_1": change("close"),
            "open_to_prev_close": ratio(F.col("open"), _earlier("close")) - 1.0,
            "volume_return_1": F.coalesce(change("volume"), F.lit(0.0)),
            "log_volume": F.log1p("volume"),
            "vwap_proxy": vwap_proxy(bars.columns),
        }
    ).withColumn("close_to_vwap", ratio("close", "vwap_proxy") - 1.0)


def rolling_features(panel: DataFrame, windows: Sequence[int] = DEFAULTS.feature_windows) -> DataFrame:
    """Levels, risk and path shape over the last w rows. Needs ``one_step``."""
    r = F.col("close_return_1")
    added: dict[str, Column] = {}
    for n in windows:
        w = _rolling(n)
        top, bottom = F.max("high").over(w), F.min("low").over(w)
        moved = F.sum(F.abs(r)).over(w)
        gained = F.sum(F.greatest(r, F.when(r.isNotNull(), 0.0))).over(w)
        lost = F.sum(F.greatest(-r, F.when(r.isNotNull(), 0.0))).over(w)
        mean, deviation = F.avg(r).over(w), F.stddev_samp(r).over(w)
        back = simple_return(F.col("close"), _earlier("close", n))
        added |= {
            f"close_return_{n}": back,
            f"volume_return_{n}": simple_return(F.col("volume"), _earlier("volume", n)),
            f"return_mean_{n}": mean,
            f"price_to_ma_{n}": ratio(F.col("close"), F.avg("close").over(w)) - 1.0,
            f"volatility_{n}": deviation,
            f"volume_ratio_{n}": ratio(F.col("volume"), F.avg("volume").over(w)),
            f"high_breakout_{n}": ratio(F.col("close"), top) - 1.0,
            f"low_rebound_{n}": ratio(F.col("close"), bottom) - 1.0,
            f"range_position_{n}": ratio(F.col("close") - bottom, top - bottom),
            f"path_efficiency_{n}": ratio(back, moved),
            f"path_consistency_{n}": ratio(mean, deviation),
            f"positive_day_ratio_{n}": F.avg(F.when(r > 0, 1.0).otherwise(0.0)).over(w),
            f"win_loss_strength_{n}": ratio(gained, lost),
        }
        if "amount" in panel.columns:
            added[f"amount_ratio_{n}"] = ratio(F.col("amount"), F.avg("amount").over(w))
        if "turnover_rate" in panel.columns:
            # Missing turnover counts as zero on top but is skipped in the mean below.
            added[f"turnover_ratio_{n}"] = ratio(
                F.coalesce("turnover_rate", F.lit(0.0)), F.avg("turnover_rate").over(w)
            )
    return panel.withColumns(added)


def rolling_correlation(left: str, right: str, rows: int) -> Column:
    """Pearson correlation over complete pairs; NULL where a side does not vary.

    Rounded to 12 digits, so that exact correlations (two points give +1 or -1)
    stay equal and tie in the date ranks instead of being ordered by rounding noise.
    """
    w = _rolling(rows)
    x, y = F.col(left), F.col(right)
    if left == "vwap_proxy":
        # The only side that may be missing: leave those rows out of the other one too.
        y = F.when(x.isNotNull(), y)
    spread = F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)
    return F.round(F.try_divide(F.covar_samp(x, y).over(w), spread), 12)


def volume_correlations(panel: DataFrame, windows: Sequence[int] = DEFAULTS.feature_windows) -> DataFrame:
    prices = {"open": "open", "close": "close", "vwap": "vwap_proxy"}
    return panel.withColumns(
        {
            f"{label}_volume_corr_{n}": rolling_correlation(price, "volume", n)
            for n in windows
            if n in CORRELATION_WINDOWS
            for label, price in prices.items()
        }
    )


def composites(panel: DataFrame, windows: Sequence[int] = DEFAULTS.feature_windows) -> DataFrame:
    """Features combining several rolling ones. Needs ``rolling_features``."""
    added: dict[str, Column] = {}
    if 10 in windows:
        added["delta_price_to_ma_10_3"] = F.col("price_to_ma_10") - _earlier("price_to_ma_10", 3)
        added["squeeze_breakout_10"] = ratio("price_to_ma_10", "volatility_10")
    if {5, 10, 20} <= set(windows):
        added["breakout_stability_20"] = F.col("high_breakout_20") * F.col("path_efficiency_10")
        added["recovery_quality_20"] = F.col("low_rebound_20") * F.col("positive_day_ratio_5")
    return panel.withColumns(added) if added else panel


def optional_levels(panel: DataFrame) -> DataFrame:
    """Zero-filled optional bar columns; percentage change as a fraction."""
    have = panel.columns
    added = {n: F.coalesce(n, F.lit(0.0)) for n in ("turnover_rate", "amplitude", "change_amount") if n in have}
    if "pct_chg" in have:
        added["pct_chg"] = F.coalesce("pct_chg", F.lit(0.0)) / F.lit(100.0)
    if "amount" in have:
        added["log_amount"] = F.log1p(F.when(F.col("amount") > 0, F.col("amount")).otherwise(F.col("amount") * 0.0))
    return panel.withColumns(added) if added else panel


def instrument_features(
    bars: DataFrame, windows: Sequence[int] = DEFAULTS.feature_windows, *, correlations: bool = True
) -> DataFrame:
    """All features that look at one instrument: one shuffle and one sort by instrument."""
    panel = rolling_features(one_step(bar_shape(bars)), windows)
    if correlations:
        panel = volume_correlations(panel, windows)
    return optional_levels(composites(panel, windows))


# --- per-date features ----------------------------------------------------


def market_state(panel: DataFrame, *, max_group_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """One row per date: average move, dispersion, breadth and leadership."""
    r, amount = F.col("close_return_1"), F.col("amount")
    averages = [
        F.avg(r).alias("market_return_mean_1"),
        F.stddev_samp(r).alias("market_return_std_1"),
        F.avg("intraday_return").alias("market_intraday_mean"),
        F.avg("price_to_ma_20").alias("market_price_to_ma_20_mean"),
        F.avg("volume_ratio_5").alias("market_volume_ratio_5_mean"),
        F.avg("amount_ratio_5").alias("market_amount_ratio_5_mean"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("market_up_ratio_1"),
    ]

    def head(n: Column) -> Column:
        return F.ceil(n * F.lit(0.1))

    if fits_one_task(panel, [DATE], max_group_rows):
        day = Window.partitionBy(DATE)
        ranked = panel.select(
            DATE, "close_return_1", "intraday_return", "price_to_ma_20", "volume_ratio_5", "amount_ratio_5", "amount",
            F.row_number().over(day.orderBy(r.desc_nulls_last())).alias("_return_place"),
            F.row_number().over(day.orderBy(amount.desc_nulls_last())).alias("_amount_place"),
            head(F.count(F.lit(1)).over(day)).alias("_head"),
        )
        state = ranked.groupBy(DATE).agg(
            *averages,
            F.avg(F.when(F.col("_return_place") <= F.col("_head"), r)).alias("market_top_decile_return_1"),
            ratio(
                F.coalesce(F.sum(F.when(F.col("_amount_place") <= F.col("_head"), amount)), F.lit(0.0)),
                F.coalesce(F.sum(amount), F.lit(0.0)),
            ).alias("market_amount_top_share_1"),
        )
    else:
        state = panel.groupBy(DATE).agg(*averages, head(F.count(F.lit(1))).alias("_head"))
        heads = broadcast_dates(state.select(DATE, "_head"))

        def top(value: str, *results: Column) -> DataFrame:
            counts = value_counts(
                panel.select(DATE, value).where(col(value).isNotNull()), [DATE], value,
                in_window=False, descending=True,
            )
            taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("_head") - F.col("before")))
            return counts.join(heads, DATE).withColumn("_taken", taken).groupBy(DATE).agg(*results)

        lead = top(
            "close_return_1",
            F.try_divide(F.sum(r * F.col("_taken")), F.sum("_taken")).alias("market_top_decile_return_1"),
        )
        share = top(
            "amount",
            ratio(F.sum(amount * F.col("_taken")), F.sum(amount * F.col("n"))).alias("market_amount_top_share_1"),
        )
        state = (
            state.drop("_head")
            .join(broadcast_dates(lead), DATE, "left")
            .join(broadcast_dates(share), DATE, "left")
            .withColumn("market_amount_top_share_1", F.coalesce("market_amount_top_share_1", F.lit(0.0)))
        )

    # One row per calendar date, so this unpartitioned window stays small.
    last_five = Window.orderBy(DATE).rowsBetween(-4, Window.currentRow)
    return state.withColumns(
        {
            "market_breadth_thrust_5": F.avg("market_up_ratio_1").over(last_five),
            "market_dispersion_trend_5": F.avg("market_return_std_1").over(last_five),
        }
    )


def excess_features(panel: DataFrame, state: DataFrame) -> DataFrame:
    """Join the market state by date and relate every instrument to it."""
    return panel.join(broadcast_dates(state), DATE, "left").withColumns(
        {
            "excess_return_1": F.col("close_return_1") - F.col("market_return_mean_1"),
            "excess_intraday_return": F.col("intraday_return") - F.col("market_intraday_mean"),
            "excess_price_to_ma_20": F.col("price_to_ma_20") - F.col("market_price_to_ma_20_mean"),
            "excess_volume_ratio_5": F.col("volume_ratio_5") - F.col("market_volume_ratio_5_mean"),
            "attention_gap_5": F.col("amount_ratio_5") - F.col("market_amount_ratio_5_mean"),
            "breadth_adjusted_return_5": F.col("close_return_5") * F.col("market_breadth_thrust_5"),
            "dispersion_adjusted_breakout_20": ratio("high_breakout_20", "market_dispersion_trend_5"),
            "leader_follow_through_5": F.col("close_return_5") - F.col("market_top_decile_return_1"),
            "amount_crowding_pressure_1": F.col("amount_ratio_5") * F.col("market_amount_top_share_1"),
        }
    )


def date_ranks(
    panel: DataFrame, sources: Sequence[str], *, max_group_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Percentile rank of each source column within its date."""
    names = {s: s + RANK_SUFFIX for s in sources}
    fits = fits_one_task(panel, [DATE], max_group_rows)
    return fractional_ranks(panel, [DATE], names, in_window=fits)


# --- the whole panel ------------------------------------------------------


def build_features(
    bars: DataFrame,
    features: Sequence[str] | str = DEFAULTS.feature_preset,
    *,
    windows: Sequence[int] = DEFAULTS.feature_windows,
    keep: Sequence[str] | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    max_history_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Bars plus the wanted features, all finite (missing becomes 0).

    Dates of more than max_group_rows and histories of more than max_history_rows are
    split; None stands for a size known to fit, -1 for one known not to.

    ``features`` is a preset name or a list of feature names; ``keep`` lists the
    bar columns to carry along (default: all). Only what is asked for is computed.
    """
    keep = list(bars.columns if keep is None else keep)
    wanted = preset_features(bars.columns, features, windows) if isinstance(features, str) else list(features)
    sources = [f.removesuffix(RANK_SUFFIX) for f in wanted if f.endswith(RANK_SUFFIX)]
    known = {f for names in feature_families(bars.columns, windows).values() for f in names}
    unknown = [f for f in wanted if f not in known]
    if unknown:
        raise ValueError(f"features not available for these bars and windows: {unknown}")

    settled = max_history_rows is None and max_group_rows in (None, -1)
    largest = {INSTRUMENT: 0, DATE: 0} if settled else largest_groups(bars, [INSTRUMENT, DATE])
    limit = None if max_group_rows is None or largest[DATE] <= max_group_rows else -1
    correlations = any("_volume_corr_" in name for name in (*wanted, *sources))
    plain = [f for f in wanted if not f.endswith(RANK_SUFFIX)]
    # A feature may replace the bar column of the same name.
    carried = [c for c in keep if c not in wanted]
    rest = [c for c in carried if c not in (INSTRUMENT, DATE)]
    distinct = list(dict.fromkeys(sources))
    size = {"rows": max_history_rows, "largest": largest[INSTRUMENT]}

    def computed(b: DataFrame) -> DataFrame:
        return in_slices(b, max(windows) + WARM_UP, 0, lambda x: instrument_features(x, windows, correlations=correlations), **size)

    needs_market = bool((set(wanted) | set(sources)) & {*MARKET, *EXCESS})
    apart = bool(distinct) and len(rest) + len(plain) >= WIDE_COLUMNS
    panel = computed(bars)
    if needs_market:
        state = market_state(panel, max_group_rows=limit)
        state = materialized(state) if apart else state
        panel = excess_features(panel, state)
    if apart:
        long = max_history_rows is not None and largest[INSTRUMENT] > max_history_rows
        panel = _ranked_first(bars, distinct, computed, (lambda p: excess_features(p, state)) if needs_market else (lambda p: p), limit, long=long)
    finished = [*rest, *[zero_filled(f).alias(f) for f in plain]]
    if not sources:
        return panel.select(*[c for c in carried if c not in rest], *finished).select(*carried, *wanted)
    if apart:
        ranks = [zero_filled(s + RANK_SUFFIX).alias(s + RANK_SUFFIX) for s in distinct]
        return panel.select(*[c for c in carried if c not in rest], *finished, *ranks).select(*carried, *wanted)
    # Every rank sorts its date once. What is not ranked travels as one struct,
    # which the sorts copy as a block instead of column by column.
    packed = panel.select(INSTRUMENT, DATE, F.struct(*(finished or [F.lit(0)])).alias("_rest"), *distinct)
    ranked = date_ranks(packed, distinct, max_group_rows=limit)
    columns = {c: F.col(c) if c in (INSTRUMENT, DATE) else F.col("_rest")[c] for c in [*carried, *plain]}
    columns |= {f: zero_filled(f) for f in wanted if f not in columns}
    return ranked.select(*[columns[c].alias(c) for c in [*carried, *wanted]])


def _ranked_first(
    bars: DataFrame, sources: Sequence[str], compute: Callable[[DataFrame], DataFrame], related: Callable[[DataFrame], DataFrame],
    limit: int | None, *, long: bool,
) -> DataFrame:
    """The panel of ``compute``, ``related`` to its market, with the date ranks of the sources; wide rows are never dealt to the dates.

    What goes to the dates and back are the bars with the ranked values, then with their ranks; the features are
    computed again behind it. Rows that share instrument and date keep their order by a number of their own.
    """
    names = [s + RANK_SUFFIX for s in sources]
    kept = [c for c in bars.columns if c not in names]
    if long:
        placed = materialized(positions(bars, [INSTRUMENT], [F.col(DATE)], "_place", in_window=False))
        placed = placed.withColumn(DATE, F.struct(DATE, "_place"))
    else:
        placed = bars.withColumn("_place", F.row_number().over(_history()))
    day = F.col(DATE)[DATE] if long else F.col(DATE)
    # Made behind the sort by instrument, so that its shuffle has the bars once.
    first = compute(placed.withColumn("_bar", F.struct(*[F.col(c) for c in kept if c != DATE])))
    narrow = related(first.withColumn(DATE, day)).select(DATE, "_place", "_bar", *sources)
    ranked = date_ranks(narrow, sources, max_group_rows=limit)
    own = [F.struct(DATE, "_place").alias(c) if c == DATE else F.col("_bar")[c].alias(c) for c in kept]
    panel = compute(ranked.select(*own, *names))
    return related(panel.withColumn(DATE, F.col(DATE)[DATE]))


def fill_missing_features(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Panel with every listed feature present and finite; absent ones become 0."""
    have = set(panel.columns)
    return panel.withColumns({f: zero_filled(f) if f in have else F.lit(0.0) for f in features})
