"""Small portfolios under a shrunk-covariance risk penalty, for all dates at once.

Per rebalance date the work is bounded by parameters, not data: a pool of
candidates, ``window`` returns each, and the subsets of the pool. Dates (and
folds, through ``by``) are independent, so everything spreads over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.config import DEFAULTS
from panelwright.functions.checks import require
from panelwright.functions.keys import DATE, INSTRUMENT
from panelwright.functions.numeric import finite, simple_return
from panelwright.operators.calendar import broadcast_dates
from panelwright.operators.ordering import fractional_ranks
from panelwright.operators.scores import all_close
from panelwright.sources.storage import materialized

FALLBACK = "covariance_fallback:insufficient common return history"
SHORT = "too few eligible instruments"


def close_history(bars: DataFrame) -> DataFrame:
    """Positive closes with ``seq``, their running count per instrument."""
    w = Window.partitionBy(INSTRUMENT).orderBy(DATE)
    usable = bars.select(INSTRUMENT, DATE, finite("close").alias("close")).where(F.col("close") > 0)
    return usable.withColumn("seq", F.row_number().over(w))


def eligible_rows(scored: DataFrame, history: DataFrame, window: int = DEFAULTS.covariance_window) -> DataFrame:
    """Scored rows whose instrument trades on the date and has window + 1 closes up to it."""
    valid = scored.where(F.col(INSTRUMENT).isNotNull() & F.col(DATE).isNotNull() & F.col("pred_score").isNotNull())
    # Only the scored dates can match, so the history is cut down to them before it is shuffled.
    dates = broadcast_dates(valid.select(DATE).distinct())
    enough = history.where(F.col("seq") >= window + 1).select(INSTRUMENT, DATE, "seq").join(dates, DATE, "left_semi")
    return valid.join(enough, [INSTRUMENT, DATE])


def candidate_pool(
    scored: DataFrame,
    history: DataFrame,
    *,
    pool: int = DEFAULTS.candidate_pool,
    window: int = DEFAULTS.covariance_window,
    k: int = DEFAULTS.top_k,
    by: Sequence[str] = (),
    on_short: str = "error",
) -> DataFrame:
    """The best ``pool`` eligible rows per date with their ``place``.

    A date with fewer than k eligible rows is an error, or left out with
    on_short="skip".
    """
    require(
        pool=(pool, pool >= k, f"{k} or more, the size of a portfolio"),
        window=(window, window >= 2, "2 or more"),
        on_short=(on_short, on_short in ("error", "skip"), "error or skip"),
    )
    date = [*by, DATE]
    order = Window.partitionBy(*date).orderBy(F.col("pred_score").desc(), F.col(INSTRUMENT).asc())
    labels = ["future_return"] if "future_return" in scored.columns else []
    best = (
        eligible_rows(scored, history, window)
        .select(*date, INSTRUMENT, "pred_score", *labels, "seq")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= pool)
        .withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy(*date)).cast("int"))
    )
    short = F.col("candidates") < k
    if on_short == "skip":
        return best.where(~short)
    message = F.concat(F.lit("fewer than the needed eligible instruments remain: "), F.col("candidates").cast("string"))
    return best.withColumn("candidates", F.when(short, F.raise_error(message).cast("int")).otherwise(F.col("candidates")))


def with_short_dates(rows: DataFrame, dates: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """rows with a ``degraded_reason``, and one row of NULL figures for every date (of dates) that has none in rows."""
    keys = [*by, DATE]
    missing = dates.select(*keys).distinct().join(rows.select(*keys).distinct(), keys, "left_anti")
    told = rows if "degraded_reason" in rows.columns else rows.withColumn("degraded_reason", F.lit(None).cast("string"))
    return told.unionByName(missing.withColumn("degraded_reason", F.lit(SHORT)), allowMissingColumns=True)


def candidate_returns(
    candidates: DataFrame,
    history: DataFrame,
    *,
    window: int = DEFAULTS.covariance_window,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by, date, place, day, daily_return): the last ``window`` returns on the pool's own dates.

    ``day`` counts back from the target date (1 = the target date itself).
    Missing closes carry the last one forward, so their return is zero, and so are returns before a candidate's
    first close. The grid holds the dates of all candidates; if it has no window + 1 of them, there are fewer days. A
    candidate's last window + 1 rows cover the grid, if it has that many.
    """
    rows = window + 1
    block = F.floor(F.col("seq") / rows)
    keys = [*by, DATE]
    # Pool rows are bounded by dates x pool (x folds), so they may be broadcast.
    wanted = candidates.select(
        *keys, "place", INSTRUMENT, F.col("seq").alias("_last"),
        F.explode(F.array(block, block - 1)).alias("_block"),
    )
    closes = history.select(INSTRUMENT, F.col(DATE).alias("_day"), "close", "seq", block.alias("_block"))
    held = (
        closes.join(F.broadcast(wanted), [INSTRUMENT, "_block"])
        .where((F.col("seq") <= F.col("_last")) & (F.col("seq") > F.col("_last") - rows))
    )
    grid = Window.partitionBy(*keys).orderBy(F.col("_day").desc())
    own = Window.partitionBy(*keys, "place").orderBy("_day")
    placed = held.select(*keys, "place", "_day", "close", F.dense_rank().over(grid).alias("_back"))
    placed = placed.withColumn("_days", F.least(F.max("_back").over(Window.partitionBy(*keys)) - 1, F.lit(window)))
    first = F.lag("_back").over(own).isNull()
    steps = placed.select(
        *keys,
        "place",
        "_back",
        "_days",
        F.when(first, F.greatest("_back", "_days")).otherwise(F.col("_back")).alias("_from"),
        F.coalesce(F.lead("_back").over(own) + 1, F.lit(1)).alias("_until"),
        simple_return(F.col("close"), F.lag("close").over(own)).alias("_moved"),
    )
    days = steps.withColumn("day", F.explode(F.sequence("_until", "_from"))).where(F.col("day") <= F.col("_days"))
    moved = F.when(F.col("day") == F.col("_back"), F.coalesce(finite("_moved"), F.lit(0.0))).otherwise(F.lit(0.0))
    return days.select(*keys, "place", "day", moved.alias("daily_return"))


def shrunk_covariance(
    returns: DataFrame, *, window: int = DEFAULTS.covariance_window, by: Sequence[str] = ()
) -> DataFrame:
    """(by, date, i, j, covariance, correlation) for i <= j, Ledoit-Wolf shrinkage.

    Dates with fewer than ``window`` days are left out.
    """
    keys = [*by, DATE]
    n = F.lit(float(window))
    own = Window.partitionBy(*keys, "place")
    centred = returns.select(*keys, "place", "day", (F.col("daily_return") - F.avg("daily_return").over(own)).alias("x"))
    # One vector per day, at most ``pool`` long; norm is its squared length.
    days = (
        centred.groupBy(*keys, "day")
        .agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v"))
        .withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, e: a + e["x"] * e["x"]))
    )
    pairs = (
        days.select(*keys, "day", "norm", "v", F.explode("v").alias("a"))
        .select(*keys, "day", "norm", "a", F.explode(F.filter("v", lambda e: e["place"] >= F.col("a.place"))).alias("b"))
        .groupBy(*keys, F.col("a.place").alias("i"), F.col("b.place").alias("j"))
        .agg(
            (F.sum(F.col("a.x") * F.col("b.x")) / n).alias("s"),
            F.sum(F.col("norm") * F.col("norm")).alias("fourth"),
            F.count(F.lit(1)).alias("days"),
        )
        .where(F.col("days") == window)
    )
    date = Window.partitionBy(*keys)
    diagonal = F.col("i") == F.col("j")
    p = F.max("j").over(date).cast("double")
    trace = F.sum(F.when(diagonal, F.col("s"))).over(date)
    squares = F.sum(F.when(diagonal, 1.0).otherwise(2.0) * F.col("s") * F.col("s")).over(date)
    mean = trace / p
    spread = (squares - F.lit(2.0) * mean * trace + p * mean * mean) / p
    noise = F.least((F.col("fourth") / n - squares) / (p * n), spread)
    share = F.when(noise == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(noise, spread), F.lit(0.0)))
    shrunk = pairs.select(*keys, "i", "j", "s", diagonal.alias("_own"), share.alias("share"), mean.alias("mean")).select(
        *keys,
        "i",
        "j",
        "_own",
        ((F.lit(1.0) - F.col("share")) * F.col("s") + F.when(F.col("_own"), F.col("share") * F.col("mean")).otherwise(0.0)).alias("covariance"),
    )

    def deviation(index: str) -> Column:
        # The diagonal entry of the same row or column inside the date's matrix.
        side = Window.partitionBy(*keys, index)
        return F.sqrt(F.greatest(F.max(F.when(F.col("_own"), F.col("covariance"))).over(side), F.lit(1e-18)))

    correlation = F.when(F.col("_own"), F.lit(1.0)).otherwise(F.col("covariance") / (deviation("i") * deviation("j")))
    return shrunk.select(*keys, "i", "j", "covariance", correlation.alias("correlation"))


def subset_statistics(
    candidates: DataFrame,
    covariances: DataFrame,
    *,
    k: int = DEFAULTS.top_k,
    by: Sequence[str] = (),
) -> DataFrame:
    """Every k-subset of each date's pool: mean score, variance, mean correlation and their ranks.

    The subsets come from nested generators over increasing places, so they
    stream out of one row per date without a join; their number depends on the
    pool size only.
    """
    keys = [*by, DATE]
    pools = candidates.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "pred_score"))), lambda e: e["pred_score"]).alias("scores"),
        F.max("candidates").alias("n"),
    )
    packed = covariances.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("i", "j", "covariance", "correlation"))).alias("m")
    )
    frame = pools.join(packed, keys).select(
        *keys, "n", "scores",
        F.transform("m", lambda e: e["covariance"]).alias("cov"),
        F.transform("m", lambda e: e["correlation"]).alias("cor"),
    )
    carried = [*keys, "n", "scores", "cov", "cor"]

    def entry(matrix: str, i: Column, j: Column) -> Column:
        # Upper triangle by rows, 1-based places, 0-based position.
        return F.get(matrix, (i - 1) * F.col("n") - F.floor((i - 1) * (i - 2) / 2).cast("int") + (j - i))

    places: list[str] = []
    for level in range(1, k + 1):
        name = f"p{level}"
        first = F.col(places[-1]) + 1 if places else F.lit(1)
        frame = frame.select(
            *carried, *places, *(["score", "var", "rho"] if places else []),
            F.explode(F.sequence(first, F.col("n") - (k - level))).alias(name),
        )
        here = F.col(name)
        score, var, rho = F.get("scores", here - 1), entry("cov", here, here), F.lit(0.0)
        for earlier in places:
            var = var + F.lit(2.0) * entry("cov", F.col(earlier), here)
            rho = rho + entry("cor", F.col(earlier), here)
        if places:
            score, var, rho = F.col("score") + score, F.col("var") + var, F.col("rho") + rho
        places.append(name)
        frame = frame.select(*carried, *places, score.alias("score"), var.alias("var"), rho.alias("rho"))
    flat = frame.select(
        *keys,
        F.array(*places).alias("places"),
        (F.col("score") / F.lit(float(k))).alias("mean_score"),
        (F.col("var") / F.lit(float(k * k))).alias("variance"),
        (F.col("rho") / F.lit(k * (k - 1) / 2.0)).alias("mean_correlation"),
    )
    return _with_risk_ranks(flat, keys)


def _with_risk_ranks(subsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average-tie percentile ranks per date; 0.5 where all subsets are alike."""
    # The groups hold the subsets of one pool: C(pool, k) rows whatever the data.
    names = {"variance": "variance_rank", "mean_correlation": "correlation_rank"}
    ranked = fractional_ranks(subsets, keys, names, in_window=True)
    first = Window.partitionBy(*keys).orderBy("places")
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def flat_or(value: str, rank: str) -> Column:
        alike = all_close(F.min(value).over(whole), F.max(value).over(whole), F.first(value).over(whole))
        return F.when(alike, F.lit(0.5)).otherwise(F.col(rank))

    return ranked.withColumns({rank: flat_or(value, rank) for value, rank in names.items()})


def penalty_pairs(variance: Sequence[float], correlation: Sequence[float]) -> Column:
    """Literal array of (variance_penalty, correlation_penalty) combinations."""
    return F.array(
        *[
            F.struct(F.lit(float(v)).alias("variance_penalty"), F.lit(float(c)).alias("correlation_penalty"))
            for v in variance
            for c in correlation
        ]
    )


def select_portfolios(
    candidates: DataFrame,
    covariances: DataFrame,
    *,
    variance_penalties: Sequence[float] = (0.0,),
    correlation_penalties: Sequence[float] = (0.0,),
    k: int = DEFAULTS.top_k,
    by: Sequence[str] = (),
    subsets: DataFrame | None = None,
) -> DataFrame:
    """The best subset per date and penalty pair, with the best k by score as fallback.

    Objective: mean score - variance penalty x variance rank - correlation penalty
    x correlation rank; ties go to the ids that come first in pool order.
    """
    keys = [*by, DATE]
    pairs = penalty_pairs(variance_penalties, correlation_penalties)
    penalties = ["variance_penalty", "correlation_penalty"]
    if subsets is None:
        # Read twice below, for the best objective and for the rows that reach it.
        subsets = materialized(subset_statistics(candidates, covariances, k=k, by=by))
    members = F.struct("place", INSTRUMENT, *[c for c in ("future_return",) if c in candidates.columns])
    pools = candidates.groupBy(*keys).agg(
        F.sort_array(F.collect_list(members)).alias("pool"),
        F.avg(F.when(F.col("place") <= k, F.col("pred_score"))).alias("top_score"),
    )
    choices = subsets.select("*", F.explode(pairs).alias("_p")).select(
        *keys, "places", "variance", "mean_correlation", "_p.*",
        (
            F.col("mean_score")
            - F.col("_p.variance_penalty") * F.col("variance_rank")
            - F.col("_p.correlation_penalty") * F.col("correlation_rank")
        ).alias("objective"),
    )
    # Keep the best objective per pair first (a map-side maximum), then break its few ties.
    best = choices.groupBy(*keys, *penalties).agg(F.max("objective").alias("objective"))
    tied = choices.join(F.broadcast(best), [*keys, *penalties, "objective"]).join(F.broadcast(pools), keys)
    ids = F.transform("places", lambda p: F.get("pool", p - 1)[INSTRUMENT])
    order = Window.partitionBy(*keys, *penalties).orderBy("_ids")
    chosen = (
        tied.withColumn("_ids", ids)
        .withColumn("_turn", F.row_number().over(order))
        .where(F.col("_turn") == 1)
        .select(
            *keys, *penalties, "places", "pool",
            F.col("variance").alias("portfolio_variance"), "mean_correlation",
            F.col("objective").alias("selection_score"), F.lit(None).cast("string").alias("degraded_reason"),
        )
    )
    without = pools.join(F.broadcast(covariances.select(*keys).distinct()), keys, "left_anti")
    fallback = without.select("*", F.explode(pairs).alias("_p")).select(
        *keys, "_p.*", F.sequence(F.lit(1), F.lit(k)).alias("places"), "pool",
        F.lit(0.0).alias("portfolio_variance"), F.lit(0.0).alias("mean_correlation"),
        F.col("top_score").alias("selection_score"), F.lit(FALLBACK).alias("degraded_reason"),
    )
    picked = chosen.unionByName(fallback)
    selected = F.transform("places", lambda p: F.get("pool", p - 1))
    columns = [
        *keys, *penalties,
        F.array_sort(F.transform("_s", lambda e: e[INSTRUMENT])).alias("stock_ids"),
        "portfolio_variance", "mean_correlation", "selection_score", "degraded_reason",
    ]
    if "future_return" in candidates.columns:
        columns.append(
            (F.aggregate("_s", F.lit(0.0), lambda a, e: a + e["future_return"]) / F.lit(float(k))).alias("portfolio_return")
        )
    return picked.withColumn("_s", selected).select(*columns)


def select_top_portfolio(
    scored: DataFrame,
    bars: DataFrame,
    *,
    pool: int = DEFAULTS.candidate_pool,
    window: int = DEFAULTS.covariance_window,
    variance_penalty: float = 0.0,
    correlation_penalty: float = 0.0,
    k: int = DEFAULTS.top_k,
    on_short: str = "error",
) -> DataFrame:
    """Risk-penalised portfolio on the latest scored date, one row."""
    latest = scored.where(F.col("pred_score").isNotNull()).agg(F.max(DATE).alias(DATE))
    current = scored.join(F.broadcast(latest), DATE, "left_semi")
    history = close_history(bars)
    candidates = candidate_pool(current, history, pool=pool, window=window, k=k, on_short=on_short)
    returns = candidate_returns(candidates, history, window=window)
    return select_portfolios(
        candidates,
        shrunk_covariance(returns, window=window),
        variance_penalties=(variance_penalty,),
        correlation_penalties=(correlation_penalty,),
        k=k,
    )


def portfolio_picks(portfolios: DataFrame, *, by: Sequence[str] = (DATE,), k: int = DEFAULTS.top_k) -> DataFrame:
    """One row per selected instrument with its equal weight."""
    return portfolios.select(*by, F.explode("stock_ids").alias(INSTRUMENT)).withColumn("weight", F.lit(1.0 / k))
