from itertools import combinations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright.operators import backtest, labels, portfolio
from tests.conftest import sine_rows


def shrunk(x):
    """Ledoit-Wolf covariance of centred columns, straight from the definition."""
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    m = np.trace(s) / p
    delta = ((s - m * np.eye(p)) ** 2).sum() / p
    beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / p / n**2
    share = min(beta, delta) / delta if delta else 0.0
    return (1 - share) * s + share * m * np.eye(p)


def average_ranks(v):
    return np.array([((v < x).sum() + ((v <= x).sum() + 1)) / 2 for x in v]) / len(v)


def brute_force(variance_penalty, correlation_penalty):
    closes = np.array([[r[3] for r in sine_rows() if r[0] == f"{s:06d}"] for s in range(15)]).T[-61:]
    cov = shrunk(closes[1:] / closes[:-1] - 1)
    sd = np.sqrt(np.diag(cov))
    cor = cov / np.outer(sd, sd)
    scores = np.array([1.0 - s / 19.0 for s in range(15)])
    sets = list(combinations(range(15), 5))
    mean = np.array([scores[list(c)].mean() for c in sets])
    var = np.array([cov[np.ix_(c, c)].sum() / 25 for c in sets])
    rho = np.array([np.mean([cor[i, j] for i, j in combinations(c, 2)]) for c in sets])
    goal = mean - variance_penalty * average_ranks(var) - correlation_penalty * average_ranks(rho)
    best = int(np.argmax(goal))
    return [f"{i:06d}" for i in sets[best]], var[best], rho[best], goal[best]


@pytest.mark.parametrize("penalties", [(0.0, 0.0), (0.5, 0.25), (1.0, 0.1)])
def test_selection_matches_brute_force(sine_bars, last_scores, penalties):
    ids, variance, correlation, objective = brute_force(*penalties)
    row = portfolio.select_top_portfolio(
        last_scores, sine_bars, variance_penalty=penalties[0], correlation_penalty=penalties[1]
    ).first()
    assert row.stock_ids == ids
    assert row.portfolio_variance == pytest.approx(variance, rel=1e-9)
    assert row.mean_correlation == pytest.approx(correlation, rel=1e-9)
    assert row.selection_score == pytest.approx(objective, rel=1e-9)
    assert row.degraded_reason is None


def test_picks_are_five_equal_weights(sine_bars, last_scores):
    chosen = portfolio.select_top_portfolio(last_scores, sine_bars, variance_penalty=0.5, correlation_penalty=0.25)
    rows = portfolio.portfolio_picks(chosen, by=()).collect()
    assert len({r.stock_id for r in rows}) == 5 and [r.weight for r in rows] == [0.2] * 5


def test_too_few_eligible_rows(sine_bars, last_scores):
    few = last_scores.where(F.col("stock_id") < "000004")
    with pytest.raises(PySparkException, match="fewer than"):
        portfolio.select_top_portfolio(few, sine_bars).collect()
    assert portfolio.select_top_portfolio(few, sine_bars, on_short="skip").count() == 0
    with pytest.raises(ValueError):
        portfolio.candidate_pool(few, portfolio.close_history(sine_bars), pool=4)


def test_missing_covariance_falls_back_to_the_best_scores(sine_bars, last_scores):
    history = portfolio.close_history(sine_bars)
    pool = portfolio.candidate_pool(last_scores, history)
    none = portfolio.shrunk_covariance(portfolio.candidate_returns(pool, history)).where(F.lit(False))
    row = portfolio.select_portfolios(pool, none, variance_penalties=(0.5,), correlation_penalties=(0.25,)).first()
    assert row.stock_ids == [f"{s:06d}" for s in range(5)]
    assert row.degraded_reason and row.portfolio_variance == 0.0
    assert row.selection_score == pytest.approx(np.mean([1 - s / 19 for s in range(5)]))


def test_missing_closes_carry_forward(spark, sine_bars, last_scores):
    gap = sine_bars.where(~((F.col("stock_id") == "000003") & (F.dayofmonth("trade_date") == 10)))
    history = portfolio.close_history(gap)
    pool = portfolio.candidate_pool(last_scores, history)
    returns = portfolio.candidate_returns(pool, history).toPandas()
    assert len(returns) == 15 * 60
    frame = gap.toPandas().pivot(index="trade_date", columns="stock_id", values="close")
    expected = frame[[f"{s:06d}" for s in range(15)]].ffill().tail(61).pct_change(fill_method=None).iloc[1:]
    found = returns.pivot(index="day", columns="place", values="daily_return").sort_index(ascending=False)
    assert np.allclose(found.to_numpy(), expected.to_numpy())


def test_series_and_grid(sine_bars):
    scored = labels.valid_samples(labels.forward_returns(sine_bars)).withColumn("pred_score", F.col("close") / 100)
    scored = scored.where(F.col("trade_date") >= F.lit("2025-12-01").cast("date"))
    series = backtest.portfolio_series(scored, sine_bars, variance_penalties=(0.0, 0.5), correlation_penalties=(0.0,))
    weeks = series.where("variance_penalty = 0").orderBy("trade_date").collect()
    assert weeks[0].jaccard_vs_previous == 1.0 and all(len(w.stock_ids) == 5 for w in weeks)
    metrics = backtest.top_k_metrics(scored).first()
    assert np.mean([w.portfolio_return for w in weeks]) == pytest.approx(metrics.pred_top_k_return_mean, abs=1e-8)
    board = backtest.leaderboard(backtest.series_statistics(series), cvar_penalties=(0.0, 1.0)).collect()
    assert sorted(r["rank"] for r in board) == [1, 2, 3, 4]
    assert backtest.select_risk_configuration(backtest.leaderboard(backtest.series_statistics(series))).count() == 1


def test_top_five_metric(scored):
    row = backtest.top_k_metrics(scored(10), k=5, stride=5).first()
    assert row.pred_top_k_return_mean == round(float(np.mean([0.01, 0.02, 0.03, 0.0, -0.01])), 8)
    assert row.evaluated_week_count == 2 and row.top_k_relative_score == 1.0
    with pytest.raises(ValueError):
        backtest.top_k_metrics(scored(10), k=0)
    empty = backtest.top_k_metrics(scored(10).where(F.lit(False))).first()
    assert empty.evaluated_week_count == 0 and empty.pred_top_k_worst == 0.0


def weekly(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "trade_date int, portfolio_return double")


def test_weekly_statistics(spark):
    values = [-0.10, -0.05, 0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08]
    row = backtest.weekly_statistics(weekly(spark, values)).first()
    assert row.cvar10 == pytest.approx(-0.075) and row.q10 == pytest.approx(np.quantile(values, 0.1))
    assert row["std"] == pytest.approx(np.std(values)) and row.week_count == 11
    for bad in ([], [0.1, float("nan")]):
        with pytest.raises(PySparkException, match="finite and non-empty"):
            backtest.weekly_statistics(weekly(spark, bad)).collect()


def test_risk_choice_prefers_robust_score(spark):
    rows = [(0.5, 0.25, 0.5, 0.03, -0.01), (0.0, 0.0, 0.0, 0.025, -0.03)]
    table = spark.createDataFrame(rows, "variance_penalty double, correlation_penalty double, cvar_penalty double, mean double, cvar10 double")
    assert backtest.select_risk_configuration(table).first().variance_penalty == 0.5


def test_final_choice_needs_every_fold(spark):
    rows = [(0, 0.0, 0.0, 0.0, 2, 0.1), (1, 0.0, 0.0, 0.0, 2, 0.1), (0, 1.0, 0.0, 0.0, 1, 0.9)]
    schema = "fold int, variance_penalty double, correlation_penalty double, cvar_penalty double, rank int, robust_score double"
    row = backtest.select_final_configuration(spark.createDataFrame(rows, schema)).first()
    assert row.variance_penalty == 0.0 and row.median_outer_rank == 2.0


def gate_rows(spark, means, worst=-0.05, old_worst=-0.10, purge=5):
    rows = [(i, purge, "equal_rank_top5", m, worst) for i, m in enumerate(means)]
    rows += [(i, purge, "overlay_top1", -0.01, old_worst) for i in range(len(means))]
    return spark.createDataFrame(
        rows, "fold int, purge_group_count int, strategy string, pred_top_k_return_mean double, pred_top_k_worst double"
    )


@pytest.mark.parametrize(
    "case, failure",
    [
        ({"means": [0.01] * 4}, None),
        ({"means": [0.01, 0.01, 0.01, -0.01]}, "latest fold too low"),
        ({"means": [-0.01] * 4}, "mean return not positive"),
        ({"means": [0.01] * 3}, "wrong number of folds"),
        ({"means": [0.01] * 4, "purge": 4}, "wrong purge"),
        ({"means": [0.01] * 4, "worst": -0.2}, "worst week not better"),
        ({"means": [0.01] * 3 + [float("nan")]}, "metric missing"),
    ],
)
def test_gates(spark, case, failure):
    assert backtest.backtest_gates(gate_rows(spark, **case), strategy="equal_rank_top5").first().first_failure == failure
    if failure == "latest fold too low":
        row = backtest.backtest_gates(gate_rows(spark, **case), strategy="equal_rank_top5", latest_floor=-0.02).first()
        assert row.first_failure is None
    if failure is None:
        assert backtest.backtest_gates(gate_rows(spark, **case), strategy="ranker_top5").first().first_failure == "strategy missing"
