"""Forward returns, relevance labels, sample weights and training noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.config import DEFAULTS
from panelwright.functions.keys import DATE, INSTRUMENT
from panelwright.functions.numeric import clamp, ratio
from panelwright.operators.calendar import broadcast_dates
from panelwright.operators.ordering import (
    MAX_GROUP_ROWS,
    fits_one_task,
    group_quantiles,
    in_slices,
    join_groups,
    largest_group,
    positions,
    sketched_quantiles,
)


def forward_returns(
    panel: DataFrame,
    *,
    buy_offset: int = DEFAULTS.future_buy_offset,
    sell_offset: int = DEFAULTS.future_sell_offset,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Return from the open ``buy_offset`` rows ahead to the open ``sell_offset`` rows ahead.

    With max_group_rows, histories longer than that are measured and cut into slices.
    """
    w = Window.partitionBy(INSTRUMENT).orderBy(DATE)

    def ahead(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {"open_t_buy": F.lead("open", buy_offset).over(w), "open_t_sell": F.lead("open", sell_offset).over(w)}
        )

    largest = 0 if max_group_rows is None else largest_group(panel, [INSTRUMENT])
    led = in_slices(panel, 0, max(buy_offset, sell_offset), ahead, rows=max_group_rows, largest=largest)
    return led.withColumn("future_return", ratio("open_t_sell", "open_t_buy") - 1.0)


def valid_samples(panel: DataFrame) -> DataFrame:
    """Rows with a label that could have been bought."""
    return panel.where(F.col("future_return").isNotNull() & (F.col("open_t_buy") > 0))


def clip_by_date(
    panel: DataFrame,
    quantile: float,
    *,
    value: str = "future_return",
    name: str = "clipped_return",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Value clipped to its two-sided quantiles within the date; no clipping at 0."""
    if quantile <= 0.0:
        return panel.withColumn(name, F.col(value))
    bounds = group_quantiles(
        panel.select(DATE, value), [DATE], value, {"_low": quantile, "_high": 1.0 - quantile},
        in_window=fits_one_task(panel, [DATE], max_group_rows),
    )
    clipped = clamp(F.col(value), F.col("_low"), F.col("_high"))
    return panel.join(broadcast_dates(bounds), DATE, "left").withColumn(name, clipped).drop("_low", "_high")


def clip_overall(
    panel: DataFrame,
    quantile: float = DEFAULTS.target_clip_quantile,
    *,
    group: Sequence[str] = (),
    value: str = "future_return",
    name: str = "target",
    max_group_rows: int | None = MAX_GROUP_ROWS,
    sketch_size: int | None = None,
) -> DataFrame:
    """Value clipped to its two-sided quantiles over the whole frame (or per fold).

    The quantiles are exact; a ``sketch_size`` (8 to 65535) takes approximate ones from sketches of that size instead.
    """
    keys = list(group) or ["_frame"]
    framed = panel if group else panel.withColumn("_frame", F.lit(0))
    ends = {"_low": quantile, "_high": 1.0 - quantile}
    if sketch_size is None:
        bounds = group_quantiles(
            framed.select(*keys, value), keys, value, ends, in_window=fits_one_task(framed, keys, max_group_rows)
        )
    else:
        bounds = sketched_quantiles(framed, keys, value, ends, sketch_size)
    # One row per frame or fold.
    clipped = clamp(F.col(value), F.col("_low"), F.col("_high"))
    return (
        framed.join(F.broadcast(bounds), keys, "left")
        .withColumn(name, clipped)
        .drop("_low", "_high", "_frame")
    )


def _fraction_from_best(panel: DataFrame, value: str, max_group_rows: int | None) -> DataFrame:
    """Adds _place / _count: position by descending value within the date, ties by id."""
    order = [F.col(value).desc(), F.col(INSTRUMENT).asc()]
    if fits_one_task(panel, [DATE], max_group_rows):
        everything = Window.partitionBy(DATE)
        return positions(panel, [DATE], order, "_place", in_window=True).withColumn(
            "_fraction", F.col("_place") / F.count(F.lit(1)).over(everything)
        )
    placed = positions(panel, [DATE], order, "_place", in_window=False)
    sizes = broadcast_dates(panel.groupBy(DATE).agg(F.count(F.lit(1)).alias("_size")))
    return join_groups(placed, sizes, [DATE]).withColumn("_fraction", F.col("_place") / F.col("_size")).drop("_size")


def relevance_labels(
    panel: DataFrame,
    *,
    buckets: int = DEFAULTS.label_buckets,
    clip_quantile: float = DEFAULTS.label_clip_quantile,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Integer label 0..buckets-1 per date, the highest for the best returns."""
    clipped = clip_by_date(panel, clip_quantile, name="_target", max_group_rows=max_group_rows)
    placed = _fraction_from_best(clipped, "_target", max_group_rows)
    score = clamp((F.lit(1.0) - F.col("_fraction")) * F.lit(float(buckets)), F.lit(0.0), F.lit(buckets - 1e-6))
    return placed.withColumn("relevance_label", F.floor(score).cast("int")).drop("_target", "_place", "_fraction")


def head_weights(
    panel: DataFrame,
    *,
    quantile: float = DEFAULTS.head_quantile,
    weight: float = DEFAULTS.head_weight,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """sample_weight: ``weight`` for the best ``quantile`` of each date, 1 elsewhere."""
    if quantile <= 0.0 or weight <= 1.0:
        return panel.withColumn("sample_weight", F.lit(1.0))
    placed = _fraction_from_best(panel, "future_return", max_group_rows)
    value = F.when(F.col("_fraction") <= quantile, F.lit(float(weight))).otherwise(F.lit(1.0))
    return placed.withColumn("sample_weight", value).drop("_place", "_fraction")


def group_weights(panel: DataFrame, group: Sequence[str] = ("qid",)) -> DataFrame:
    """Mean sample weight and size of every ranking group."""
    return panel.groupBy(*group).agg(
        F.avg("sample_weight").alias("group_weight"), F.count(F.lit(1)).alias("group_size")
    )


# --- keyed noise ----------------------------------------------------------


def _uniform(*parts: Column) -> Column:
    """Uniform number in (0, 1) from the MD5 of the given values as text, so that other engines agree."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def keyed_normal(seed: int, name: str, keys: Sequence[str] = (INSTRUMENT, DATE)) -> Column:
    """Standard normal number per row and column name, the same on any partitioning."""
    base = [F.lit(seed), F.lit(name), *[F.col(k) for k in keys]]
    radius = F.sqrt(F.lit(-2.0) * F.log(_uniform(*base, F.lit(1))))
    return radius * F.cos(F.lit(6.283185307179586) * _uniform(*base, F.lit(2)))


def noisy_features(
    panel: DataFrame,
    features: Sequence[str],
    *,
    seed: int = DEFAULTS.seed,
    noise_std: float = DEFAULTS.noise_std,
    fraction: float = DEFAULTS.noise_fraction,
) -> DataFrame:
    """Gaussian noise on a seeded choice of feature columns, scaled to their spread."""
    if not features:
        return panel
    spreads = panel.agg(*[F.stddev_samp(f).alias(f"_sd_{f}") for f in features])
    # The choice depends on seed and name only, so it is the same for every row.
    changed = {
        f: F.when(
            _uniform(F.lit(seed), F.lit(f)) < fraction,
            F.col(f)
            + keyed_normal(seed, f) * F.lit(noise_std) * (F.coalesce(f"_sd_{f}", F.lit(0.0)) + F.lit(1e-12)),
        ).otherwise(F.col(f))
        for f in features
    }
    spread_columns = [f"_sd_{f}" for f in features]
    one_row = F.broadcast(spreads.withColumn("_frame", F.lit(0)))
    joined = panel.withColumn("_frame", F.lit(0)).join(one_row, "_frame")
    return joined.withColumns(changed).drop("_frame", *spread_columns)
