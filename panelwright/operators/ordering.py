"""Ranks, positions and exact quantiles inside groups of any size.

Groups that fit in one task use a window. When the largest group is measured
above ``max_group_rows`` the same answer comes from range-partitioned slices:
equal values are pre-aggregated, every slice gets a running total, and the
totals of the earlier slices are added. No group then sits in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.config import DEFAULTS
from panelwright.functions.keys import DATE, INSTRUMENT
from panelwright.functions.numeric import finite
from panelwright.sources.storage import materialized

MAX_GROUP_ROWS = DEFAULTS.max_group_rows
# Values repeated more often than this are joined back by broadcast; there can
# be at most rows / HOT_VALUE_ROWS of them, and HOT_VALUES_MAX bounds the table.
HOT_VALUE_ROWS = 1_000_000
HOT_VALUES_MAX = 10_000


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows in the largest group: one number, counted map-side first."""
    if not group:
        return df.count()
    top = df.groupBy(*group).count().agg(F.max("count").alias("rows")).first()
    return top["rows"] or 0


def largest_groups(df: DataFrame, keys: Sequence[str]) -> dict[str, int]:
    """Rows in the largest group of each key, all keys in one job."""
    counts = df.groupingSets([[k] for k in keys], *keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.grouping(k).alias(f"_off_{k}") for k in keys]
    )
    top = counts.agg(*[F.max(F.when(F.col(f"_off_{k}") == 0, F.col("_rows"))).alias(k) for k in keys]).first()
    return {k: top[k] or 0 for k in keys}


def fits_one_task(df: DataFrame, group: Sequence[str], max_group_rows: int | None) -> bool:
    """Whether every group may be handled by one window task (None: known bounded)."""
    return max_group_rows is None or largest_group(df, group) <= max_group_rows


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys, as they do inside a window's group."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    weight: Column,
    name: str,
    *,
    in_window: bool,
) -> DataFrame:
    """Sum of ``weight`` over the rows that come earlier in the same group.

    ``order`` must be total inside a group. Small groups use one window; others
    are cut into range slices whose totals are carried forward.
    """
    before = (Window.unboundedPreceding, -1)
    if in_window:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(*before)
        return df.withColumn(name, F.coalesce(F.sum(weight).over(w), F.lit(0)))

    sliced = materialized(
        df.repartitionByRange(*[F.col(g) for g in group], *order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_weight", weight)
    )
    keys = [*group, "_slice"]
    slices = Window.partitionBy(*group).orderBy("_slice").rowsBetween(*before)
    offsets = (
        sliced.groupBy(*keys)
        .agg(F.sum("_weight").alias("_total"))
        .select(*keys, F.coalesce(F.sum("_total").over(slices), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
    return (
        sliced.withColumn(name, F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .withColumn("_inside", F.col(name))
        .transform(lambda rows: join_groups(rows, offsets, keys))
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_slice", "_weight", "_offset", "_inside")
    )


def positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str,
    *,
    in_window: bool,
) -> DataFrame:
    """1-based position of every row in its group."""
    if in_window:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return running_total(df, group, order, F.lit(1), name, in_window=False).withColumn(
        name, (F.col(name) + 1).cast("int")
    )


def in_slices(
    bars: DataFrame, back: int, ahead: int, compute: Callable[[DataFrame], DataFrame], *, rows: int | None, largest: int
) -> DataFrame:
    """``compute`` (windows by instrument and date) on histories of any length.

    Histories of at most ``rows`` rows (``largest`` is the measured longest) go
    through as they are. Longer ones are cut into slices of ``rows`` rows; each slice also
    gets the ``back`` rows before it and the ``ahead`` rows behind it, which
    ``compute`` sees and the result leaves out.
    """
    if rows is None or largest <= rows:
        return compute(bars)
    size = max(rows, back, ahead, 1)
    placed = positions(bars, [INSTRUMENT], [F.col(DATE)], "_at", in_window=False)
    own = F.floor((F.col("_at") - 1) / size)
    within = F.pmod(F.col("_at") - 1, F.lit(size))
    slices = F.array_compact(F.array(own, F.when(within >= size - back, own + 1), F.when((within < ahead) & (own > 0), own - 1)))
    cut = placed.withColumn("_own", own).withColumn("_slice", F.explode(slices)).withColumn("_id", F.col(INSTRUMENT))
    named = cut.withColumn(INSTRUMENT, F.concat_ws("|", F.hex(F.coalesce("_id", F.lit("")).cast("binary")), F.isnull("_id").cast("string"), "_slice"))
    done = compute(named).where(F.col("_slice") == F.col("_own")).withColumn(INSTRUMENT, F.col("_id"))
    return done.drop("_at", "_own", "_slice", "_id")


def value_counts(
    df: DataFrame, group: Sequence[str], value: str, *, in_window: bool, descending: bool = False
) -> DataFrame:
    """Distinct values per group with their count ``n`` and the rows ``before`` them."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    return running_total(counts, group, [order], F.col("n"), "before", in_window=in_window)


def fractional_ranks(
    df: DataFrame,
    group: Sequence[str],
    values: dict[str, str],
    *,
    missing: str = "exclude",
    in_window: bool,
) -> DataFrame:
    """Average-tie rank divided by the number of ranked rows, per group.

    ``values`` maps value column to rank column. NULL group keys are a group of
    their own, and copies of a row are ranked like any ties.
    missing="exclude" leaves NULL unranked and uncounted, missing="lowest" ranks
    NULL and non-finite values below everything else.
    """
    if missing not in ("exclude", "lowest"):
        raise ValueError(f"missing must be 'exclude' or 'lowest': {missing}")
    lowest = missing == "lowest"
    if in_window:
        for v, r in values.items():
            # One step per rank keeps only the finished rank for the next sort.
            df = df.withColumn(r, _window_rank(v, group, lowest))
        return df
    return _distributed_ranks(df, group, values, lowest)


def _window_rank(value: str, group: Sequence[str], lowest: bool) -> Column:
    x = finite(value)
    order = x.asc_nulls_first() if lowest else x.asc_nulls_last()
    counted = F.lit(1) if lowest else x
    w = Window.partitionBy(*group).orderBy(order)
    up_to_here = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean_rank = (F.rank().over(w) + F.count(counted).over(up_to_here)) / F.lit(2.0)
    fraction = mean_rank / F.count(counted).over(everything)
    return fraction if lowest else F.when(x.isNotNull(), fraction)


def _step_of(value: str) -> Column:
    """A whole number that never falls while the value rises; at most some 4 096 different values share one."""
    x = F.col(value)
    size = F.floor((F.log2(F.abs(x)) + F.lit(1100.0)) * F.lit(float(1 << 40)))
    ends = F.when(x == F.lit(float("inf")), F.lit(1 << 62)).when(x == F.lit(float("-inf")), F.lit(-(1 << 62)))
    return ends.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)).cast("long")


def _distributed_ranks(df: DataFrame, group: Sequence[str], values: dict[str, str], lowest: bool) -> DataFrame:
    """One shuffle deals all values by range, sorted and numbered inside each slice; the rows of earlier slices are added."""
    group = list(group)
    # Rows get numbers of their own, stored with them, so copies of a key stay separate rows.
    df = materialized(df.withColumn("_row", F.monotonically_increasing_id()))
    names = list(values)
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("_series"),
                (F.coalesce(finite(v), F.lit(float("-inf"))) if lowest else finite(v)).alias("_value"),
            )
            for i, v in enumerate(names)
        ]
    )
    series = df.select("_row", *group, F.explode(pairs).alias("_p")).select("_row", *group, "_p._series", "_p._value")
    series = series.where(F.col("_value").isNotNull())
    keys = [*group, "_series"]
    hot = _hot_values(df, series, group, keys)
    ranked = _slice_ranks(series if hot is None else _hot_as_one_row(series, hot, keys), hot, keys)
    if hot is None:
        per_row = ranked
    else:
        ranked = materialized(ranked)
        known = F.broadcast(ranked.where(F.col("_row").isNull()).select(*keys, "_value", "_rank"))
        found = join_groups(series, known, [*keys, "_value"]).select("_row", "_series", "_rank")
        per_row = ranked.where(F.col("_row").isNotNull()).select("_row", "_series", "_rank").unionByName(found)
    wide = per_row.groupBy("_row").agg(
        *[F.max(F.when(F.col("_series") == i, F.col("_rank"))).alias(values[v]) for i, v in enumerate(names)]
    )
    return df.join(wide, "_row", "left").drop("_row")


def _hot_values(df: DataFrame, series: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame | None:
    """Values held by so many rows that one task should not have them all, with their count ``n``; None if there are none.

    They are few (rows / limit), so they go by broadcast. Nothing is counted where no group has as many rows.
    """
    limit = max(HOT_VALUE_ROWS, df.count() // HOT_VALUES_MAX)
    if largest_group(df, group) <= limit:
        return None
    hot = materialized(series.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
    return None if hot.isEmpty() else hot


def _hot_as_one_row(series: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of rare values, and for each hot value one row without a number."""
    rare = join_groups(series, F.broadcast(hot.drop("n")), [*keys, "_value"], "left_anti")
    return rare.unionByName(hot.select(F.lit(None).cast("long").alias("_row"), *keys, "_value"))


def _slice_ranks(series: DataFrame, hot: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """``_rank`` of every row of (_row, keys, _value), an average-tie rank divided by the rows of its group and series."""
    by = [*keys, "_step"]
    # The step is made again behind the shuffle instead of travelling.
    dealt = series.repartitionByRange(*[F.col(k) for k in keys], _step_of("_value"))
    dealt = dealt.withColumn("_step", _step_of("_value")).sortWithinPartitions(*by, "_value")
    # Numbers rise inside a slice, which stands in the bits above. Steps, unlike doubles, let the windows below keep the slices.
    numbered = dealt.withColumn("_number", F.monotonically_increasing_id())
    step = Window.partitionBy(*by)
    lower, upto = F.rank().over(step.orderBy("_value")) - 1, step.orderBy("_value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = ["_row", *keys] if hot is None else ["_row", *keys, "_value"]
    sliced = materialized(
        numbered.withColumns({"_lower": lower, "_upto": F.count(F.lit(1)).over(upto), "_head": F.min("_number").over(step)}).select(
            *kept, F.shiftright("_head", 33).alias("_slice"),
            (F.col("_head").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_lower")).alias("_first"), (F.col("_upto") - F.col("_lower")).alias("n"),
        )
    )
    parts = sliced.groupBy(*keys, "_slice").agg(F.min("_first").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each group, series and slice that meet.
    bounds = materialized(
        parts.withColumns(
            {"_offset": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "_total": F.sum("_rows").over(Window.partitionBy(*keys))}
        ).drop("_rows")
    )
    placed = join_groups(sliced, bounds, [*keys, "_slice"]).withColumn("_before", F.col("_offset") + F.col("_first") - F.col("_start"))
    if hot is not None:
        # The one row of a hot value stands for n of them.
        held = hot.groupBy(*keys).agg(F.collect_list(F.struct("_value", "n")).alias("_hot")).withColumnsRenamed({k: f"_right_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & placed[k].eqNullSafe(held[f"_right_{k}"])
        placed = placed.join(F.broadcast(held), same, "left").drop(*[f"_right_{k}" for k in keys])

        def more(keep) -> Column:
            found = F.filter(F.coalesce("_hot", F.array().cast("array<struct<_value:double,n:bigint>>")), keep)
            return F.aggregate(found, F.lit(0).cast("long"), lambda t, h: t + h["n"] - 1)

        own = F.aggregate(F.filter("_hot", lambda h: h["_value"] == F.col("_value")), F.lit(0).cast("long"), lambda t, h: t + h["n"])
        placed = placed.withColumns(
            {
                "_before": F.col("_before") + more(lambda h: h["_value"] < F.col("_value")),
                "_total": F.col("_total") + more(lambda h: F.lit(True)),
                "n": F.when(F.col("_row").isNull(), own).otherwise(F.col("n")),
            }
        )
    rank = (F.col("_before") + (F.col("n") + 1) / F.lit(2.0)) / F.col("_total")
    return placed.select("_row", *[c for c in (["_series"] if hot is None else [*keys, "_value"])], rank.alias("_rank"))


def group_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    *,
    in_window: bool,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, NULL values ignored."""
    rows = df.where(F.col(value).isNotNull())
    if in_window:
        return rows.groupBy(*group).agg(*[F.percentile(value, q).alias(n) for n, q in quantiles.items()])

    whole = not group
    group = list(group) or ["_all"]
    rows = rows.withColumn("_all", F.lit(0)) if whole else rows
    counts = materialized(value_counts(rows, group, value, in_window=False))
    totals = counts.groupBy(*group).agg((F.sum("n") - 1).alias("_last"))
    placed = join_groups(counts, totals, group)
    first, after = F.col("before"), F.col("before") + F.col("n")

    def value_at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < after), F.col(value)))

    columns = []
    for name, q in quantiles.items():
        exact = F.col("_last") * F.lit(q)
        low, high = F.floor(exact), F.ceil(exact)
        part = F.max(exact - low)
        columns.append((value_at(low) * (F.lit(1.0) - part) + value_at(high) * part).alias(name))
    result = placed.groupBy(*group).agg(*columns)
    return result.drop("_all") if whole else result


def sketched_quantiles(df: DataFrame, group: Sequence[str], value: str, quantiles: dict[str, float], size: int) -> DataFrame:
    """Approximate quantiles per group from mergeable sketches: one pass, a few kilobytes a group, no sort; NULL values ignored.

    Each result is a value of the group; its rank is off by about 2.3 / size^0.9 of the group's rows (0.1 % at 4096). A group
    of at most ``size`` values is exact but for interpolation. Sketches draw at random, so reruns may differ within that error.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_value"))
    sketches = rows.groupBy(*group).agg(F.kll_sketch_agg_double("_value", F.lit(size)).alias("_sketch"))
    found = {n: F.kll_sketch_get_quantile_double("_sketch", F.lit(float(q))) for n, q in quantiles.items()}
    return sketches.select(*group, *[c.alias(n) for n, c in found.items()])
