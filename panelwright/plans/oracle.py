"""DuckDB SQL that computes the registered queries independently on the same tables."""

from __future__ import annotations

WINDOWS = (3, 5, 10, 20)
METRICS = (
    "pred_top_k_return_mean", "pred_top_k_return_median", "pred_top_k_return_std", "pred_top_k_positive_rate",
    "pred_top_k_q10", "pred_top_k_cvar10", "pred_top_k_worst", "oracle_top_k_return_mean",
    "baseline_top_k_return_mean", "top_k_relative_score",
)
EPS = "1e-12"
MODELS = ("ranker_a", "ranker_b", "regressor")
CTES: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLE: dict[str, str] = {}


def cte(name: str, needs: tuple[str, ...], sql: str) -> None:
    CTES[name] = (needs, sql)


def _collect(names, seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _collect(CTES[name][0], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_ctes(sql: str, *needs: str) -> str:
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in _collect(needs, [])]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def oracle(name: str, needs: tuple[str, ...], sql: str) -> None:
    ORACLE[name] = with_ctes(sql, *needs)


def r(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) + 0.0 AS {name or c}"


def damped(c: str, name: str | None = None) -> str:
    return f"round(sign({c}) * ln(1 + abs({c})), 6) + 0.0 AS {name or c}"


def d(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {name or c}"


def i(c: str, name: str | None = None) -> str:
    return f"CAST({c} AS BIGINT) AS {name or c}"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}) + {EPS}, 0))"


def many(f, names) -> str:
    return ", ".join(f(n) for n in names)


WIDE = {
    *(f"{n}_{w}" for w in WINDOWS for n in ("path_consistency", "win_loss_strength", "path_efficiency")),
    "squeeze_breakout_10", "dispersion_adjusted_breakout_20", "price_position", "breakout_stability_20",
}
KEYS = f"stock_id, {d('trade_date')}"


def value(name: str) -> str:
    return damped(name) if name in WIDE else r(name)


def zero(name: str) -> str:
    inner = f"coalesce({name}, 0)"
    return damped(inner, name) if name in WIDE else r(inner, name)


# --- bars -----------------------------------------------------------------

LINE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey"
cte("lines", (), f"""
    SELECT *, 100 + l_extendedprice / 1000 AS px, CAST(date_trunc('week', l_shipdate) AS DATE) AS wk FROM lineitem""")
cte("raw_bars", ("lines",), f"""
    SELECT lpad(CAST(l_suppkey AS VARCHAR), greatest(6, length(CAST(l_suppkey AS VARCHAR)))::INT, '0') AS stock_id, wk AS trade_date,
      first(px ORDER BY {LINE_ORDER}) AS open, last(px ORDER BY {LINE_ORDER}) AS close,
      max(px) AS high, min(px) AS low, sum(l_quantity) AS volume, sum(px * l_quantity) AS amount,
      100 * sum(l_quantity) FILTER (l_returnflag = 'N') / 10000 AS turnover_rate
    FROM lines GROUP BY 1, 2""")
BY_ID = "PARTITION BY stock_id ORDER BY trade_date"
cte("bars", ("raw_bars",), f"""
    SELECT *, {ratio('high - low', 'prev')} * 100 AS amplitude, close - prev AS change_amount,
      (close / nullif(prev, 0) - 1) * 100 AS pct_chg
    FROM (SELECT *, lag(close) OVER ({BY_ID}) AS prev FROM raw_bars)""")
NUMBERS = ("open", "close", "high", "low", "volume", "amount", "amplitude", "change_amount", "pct_chg", "turnover_rate")
oracle("bars", ("bars",), f"SELECT {KEYS}, {many(r, NUMBERS)} FROM bars")
oracle("bars_round_trip", ("bars",), f"""
    SELECT fmt, {KEYS}, {many(r, NUMBERS)} FROM bars, (VALUES ('csv'), ('parquet')) f(fmt)""")
oracle("standardized_bars", ("bars",), f"""
    SELECT {KEYS}, {many(r, ('open', 'close', 'high', 'low', 'volume', 'amount', 'turnover_rate'))}
    FROM bars WHERE high <> low""")
cte("raw_ids", (), """
    SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN '  ' || s_suppkey || ' ' WHEN 1 THEN 'sh.' || s_suppkey
      WHEN 2 THEN 'SZ.' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') WHEN 3 THEN s_suppkey || '.0'
      WHEN 4 THEN s_name ELSE 'NaN' END AS raw_id FROM supplier""")
cte("ids", ("raw_ids",), """
    SELECT s_suppkey, raw_id, CASE WHEN lower(trim(raw_id)) IN ('nan', '') THEN ''
      WHEN s_suppkey % 6 = 4 THEN trim(raw_id)
      ELSE lpad(regexp_extract(raw_id, '([0-9]+)', 1), 6, '0') END AS stock_id FROM raw_ids""")
oracle("normalized_ids", ("ids",), f"SELECT {i('s_suppkey')}, raw_id, stock_id FROM ids")
oracle("six_digit_ids", ("ids",), f"""
    SELECT {i('count(*)', 'ids')}, {i("count(*) FILTER (regexp_matches(stock_id, '^[0-9]{6}$'))", 'good_ids')},
      {i("count(*) FILTER (NOT regexp_matches(lpad(trim(raw_id), greatest(6, length(trim(raw_id)))::INT, '0'), '^[0-9]{6}$'))", 'bad_id_count')}
    FROM ids""")
oracle("derived_bar_fields", ("bars",), f"SELECT {KEYS}, {many(r, NUMBERS)} FROM bars")
oracle("union_histories", ("bars",), f"""
    SELECT stock_id, {i('count(*)', 'bars')}, {d('min(trade_date)', 'first_date')}, {d('max(trade_date)', 'last_date')},
      {i("count(amplitude) FILTER (trade_date <= middle)", 'amplitudes')}, {r('sum(close)', 'close_sum')}
    FROM bars, (SELECT min(trade_date)::DATE + ((max(trade_date)::DATE - min(trade_date)::DATE) // 2)::INT AS middle FROM bars) GROUP BY 1""")


def canonical(c: str, kind: str = "number") -> str:
    return f"coalesce({'printf(' + chr(39) + '%.9e' + chr(39) + ', ' + c + '::DOUBLE + 0.0)' if kind == 'number' else c}, '~')"


oracle("fingerprint", ("bars",), f"""
    SELECT row_count, sha256('stock_id,trade_date,{",".join(NUMBERS)}|' || row_count || '|' || total || '|' || parity) AS sha256 FROM (
      SELECT count(*) AS row_count, sum(h) AS total, bit_xor(h) AS parity FROM (
        SELECT ('0x' || md5({" || '|' || ".join([canonical('stock_id', 'text'), canonical("strftime(trade_date, '%Y-%m-%d')", 'text'), *map(canonical, NUMBERS)])})[1:15])::BIGINT AS h
        FROM bars))""")
oracle("profile", ("bars",), f"""
    SELECT {i('count(*)', 'row_count')}, {i('12', 'column_count')}, 'stock_id' AS stock_id_column,
      {i('count(DISTINCT stock_id)', 'unique_stock_count')}, 'trade_date' AS date_column FROM bars""")
oracle("date_split", ("bars",), f"""
    SELECT * FROM (SELECT CASE WHEN trade_date BETWEEN DATE '1995-01-02' AND DATE '1998-12-28' THEN 'train'
      WHEN trade_date BETWEEN DATE '1999-01-04' AND DATE '1999-06-28' THEN 'test' END AS part,
      {KEYS}, {many(r, ('open', 'close', 'volume'))} FROM bars) WHERE part IS NOT NULL""")

# --- features -------------------------------------------------------------

SHAPE = {
    "intraday_return": f"{ratio('close', 'open')} - 1",
    "high_low_range": ratio("high - low", "open"),
    "close_to_high": f"{ratio('close', 'high')} - 1",
    "close_to_low": f"{ratio('close', 'low')} - 1",
    "price_position": ratio("close - low", "high - low"),
    "upper_shadow": ratio("high - greatest(open, close)", "open"),
    "lower_shadow": ratio("least(open, close) - low", "open"),
}


def step(c: str) -> str:
    return f"coalesce({c} / nullif(lag({c}) OVER ({BY_ID}), 0) - 1, 0)"


cte("stepped", ("bars",), f"""
    SELECT *, {ratio('close', 'vwap_proxy')} - 1 AS close_to_vwap FROM (
      SELECT *, {', '.join(f'{e} AS {n}' for n, e in SHAPE.items())},
        {step('open')} AS open_gap_1, {step('close')} AS close_return_1,
        {ratio('open', f'lag(close) OVER ({BY_ID})')} - 1 AS open_to_prev_close,
        {step('volume')} AS volume_return_1, ln(1 + volume) AS log_volume,
        {ratio('amount', 'volume')} AS vwap_proxy
      FROM bars)""")
oracle("bar_shape", ("stepped",), f"SELECT {KEYS}, {many(value, SHAPE)} FROM stepped")
STEPS = ("open_gap_1", "close_return_1", "open_to_prev_close", "volume_return_1", "log_volume")
oracle("one_step", ("stepped",), f"SELECT {KEYS}, {many(r, (*STEPS, 'vwap_proxy', 'close_to_vwap'))} FROM stepped")
oracle("typical_price_vwap", ("bars",), f"""
    SELECT {KEYS}, round((open + high + low + close) / 4, 9) AS vwap_proxy,
      round({ratio('close', '(open + high + low + close) / 4')} - 1, 9) + 0.0 AS close_to_vwap FROM bars""")
oracle("optional_levels", ("bars",), f"""
    SELECT {KEYS}, {many(lambda c: r(f'coalesce({c}, 0)', c), ('turnover_rate', 'amplitude', 'change_amount'))},
      {r('coalesce(pct_chg, 0) / 100', 'pct_chg')}, {r('ln(1 + greatest(amount, 0))', 'log_amount')} FROM bars""")


def rolled_columns() -> str:
    out = []
    for n in WINDOWS:
        w = f"OVER w{n}"
        back = f"(close / nullif(lag(close, {n}) OVER w0, 0) - 1)"
        top, low = f"max(high) {w}", f"min(low) {w}"
        x = {
            "close_return": back,
            "volume_return": f"volume / nullif(lag(volume, {n}) OVER w0, 0) - 1",
            "return_mean": f"avg(close_return_1) {w}",
            "price_to_ma": f"{ratio('close', f'avg(close) {w}')} - 1",
            "volatility": f"stddev_samp(close_return_1) {w}",
            "volume_ratio": ratio("volume", f"avg(volume) {w}"),
            "amount_ratio": ratio("amount", f"avg(amount) {w}"),
            "high_breakout": f"{ratio('close', top)} - 1",
            "low_rebound": f"{ratio('close', low)} - 1",
            "range_position": ratio(f"close - {low}", f"{top} - {low}"),
            "path_efficiency": ratio(back, f"sum(abs(close_return_1)) {w}"),
            "path_consistency": ratio(f"avg(close_return_1) {w}", f"stddev_samp(close_return_1) {w}"),
            "positive_day_ratio": f"avg(CASE WHEN close_return_1 > 0 THEN 1.0::DOUBLE ELSE 0 END) {w}",
            "win_loss_strength": ratio(
                f"sum(greatest(close_return_1, 0)) {w}", f"sum(greatest(-close_return_1, 0)) {w}"
            ),
            "turnover_ratio": ratio("coalesce(turnover_rate, 0)", f"avg(turnover_rate) {w}"),
        }
        out += [f"{e} AS {k}_{n}" for k, e in x.items()]
    for n in (10, 20):
        for label, c in (("open", "open"), ("close", "close"), ("vwap", "vwap_proxy")):
            # corr is NaN where a side does not vary.
            corr = f"corr({c}, volume) OVER w{n}"
            out.append(f"CASE WHEN isfinite({corr}) THEN round({corr}, 12) END AS {label}_volume_corr_{n}")
    return ",\n".join(out)


FRAMES = ", ".join(f"w{n} AS ({BY_ID} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in WINDOWS)
cte("rolled", ("stepped",), f"SELECT *, {rolled_columns()} FROM stepped WINDOW w0 AS ({BY_ID}), {FRAMES}")
cte("panel", ("rolled",), f"""
    SELECT *, price_to_ma_10 - lag(price_to_ma_10, 3) OVER ({BY_ID}) AS delta_price_to_ma_10_3,
      {ratio('price_to_ma_10', 'volatility_10')} AS squeeze_breakout_10,
      high_breakout_20 * path_efficiency_10 AS breakout_stability_20,
      low_rebound_20 * positive_day_ratio_5 AS recovery_quality_20
    FROM rolled""")


def windowed(*names: str) -> list[str]:
    return [f"{n}_{w}" for w in WINDOWS for n in names]


LEVELS = windowed(
    "close_return", "volume_return", "price_to_ma", "volume_ratio", "amount_ratio", "high_breakout", "low_rebound",
    "range_position", "return_mean",
)
for name, columns in {
    "rolling_levels": LEVELS,
    "rolling_risk": windowed("volatility", "positive_day_ratio", "win_loss_strength"),
    "rolling_corr": [f"{p}_volume_corr_{w}" for w in (10, 20) for p in ("open", "close", "vwap")],
    "path_shape": windowed("path_efficiency", "path_consistency"),
    "composites": ["delta_price_to_ma_10_3", "squeeze_breakout_10", "breakout_stability_20", "recovery_quality_20"],
    "turnover_ratio": windowed("turnover_ratio"),
}.items():
    oracle(name, ("panel",), f"SELECT {KEYS}, {many(value, columns)} FROM panel")

cte("state", ("panel",), f"""
    SELECT *, avg(market_up_ratio_1) OVER f AS market_breadth_thrust_5,
      avg(market_return_std_1) OVER f AS market_dispersion_trend_5
    FROM (
      SELECT trade_date, avg(close_return_1) AS market_return_mean_1, stddev_samp(close_return_1) AS market_return_std_1,
        avg(intraday_return) AS market_intraday_mean, avg(price_to_ma_20) AS market_price_to_ma_20_mean,
        avg(volume_ratio_5) AS market_volume_ratio_5_mean, avg(amount_ratio_5) AS market_amount_ratio_5_mean,
        avg(CASE WHEN close_return_1 > 0 THEN 1.0::DOUBLE ELSE 0 END) AS market_up_ratio_1,
        avg(close_return_1) FILTER (rp <= ceil(n * 0.1::DOUBLE)) AS market_top_decile_return_1,
        {ratio('coalesce(sum(amount) FILTER (ap <= ceil(n * 0.1::DOUBLE)), 0)', 'coalesce(sum(amount), 0)')} AS market_amount_top_share_1
      FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY close_return_1 DESC NULLS LAST) AS rp,
              row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC NULLS LAST) AS ap,
              count(*) OVER (PARTITION BY trade_date) AS n FROM panel)
      GROUP BY trade_date)
    WINDOW f AS (ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
MARKET_ALL = (
    "market_return_mean_1", "market_return_std_1", "market_intraday_mean", "market_price_to_ma_20_mean",
    "market_volume_ratio_5_mean", "market_amount_ratio_5_mean", "market_up_ratio_1", "market_top_decile_return_1",
    "market_amount_top_share_1", "market_breadth_thrust_5", "market_dispersion_trend_5",
)
oracle("market_state", ("state",), f"SELECT {d('trade_date')}, {many(r, MARKET_ALL)} FROM state")
EXCESS = {
    "excess_return_1": "close_return_1 - market_return_mean_1",
    "excess_intraday_return": "intraday_return - market_intraday_mean",
    "excess_price_to_ma_20": "price_to_ma_20 - market_price_to_ma_20_mean",
    "excess_volume_ratio_5": "volume_ratio_5 - market_volume_ratio_5_mean",
    "attention_gap_5": "amount_ratio_5 - market_amount_ratio_5_mean",
    "breadth_adjusted_return_5": "close_return_5 * market_breadth_thrust_5",
    "dispersion_adjusted_breakout_20": ratio("high_breakout_20", "market_dispersion_trend_5"),
    "leader_follow_through_5": "close_return_5 - market_top_decile_return_1",
    "amount_crowding_pressure_1": "amount_ratio_5 * market_amount_top_share_1",
}
cte("excess", ("panel", "state"), f"""
    SELECT p.*, {', '.join(MARKET_ALL)}, {', '.join(f'{e} AS {n}' for n, e in EXCESS.items())}
    FROM panel p LEFT JOIN state s USING (trade_date)""")
oracle("excess_features", ("excess",), f"SELECT {KEYS}, {many(value, EXCESS)} FROM excess")


def pct_rank(c: str, part: str = "PARTITION BY trade_date") -> str:
    tie = f"{part}, {c}" if part else f"PARTITION BY {c}"
    return (
        f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {c} NULLS LAST) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE)"
        f" / count({c}) OVER ({part}) END"
    )


RANKED = (
    "close_return_1", "intraday_return", "price_to_ma_5", "price_to_ma_20", "volume_ratio_5", "volatility_10",
    "close_to_vwap", "delta_price_to_ma_10_3", "open_volume_corr_20", "path_efficiency_10", "path_consistency_10",
    "excess_return_1", "excess_price_to_ma_20", "excess_volume_ratio_5", "breadth_adjusted_return_5",
    "dispersion_adjusted_breakout_20", "attention_gap_5", "positive_day_ratio_10", "win_loss_strength_10",
    "squeeze_breakout_10", "breakout_stability_20", "recovery_quality_20",
)
OPTIONAL = ("turnover_rate", "amplitude", "pct_chg")
cte("levels", ("excess",), """
    SELECT * REPLACE (coalesce(turnover_rate, 0) AS turnover_rate, coalesce(amplitude, 0) AS amplitude,
      coalesce(change_amount, 0) AS change_amount, coalesce(pct_chg, 0) / 100 AS pct_chg), ln(1 + greatest(amount, 0)) AS log_amount
    FROM excess""")
cte("ranked", ("levels",), f"""
    SELECT *, {', '.join(f'{pct_rank(c)} AS {c}_cs_rank' for c in (*RANKED, *OPTIONAL))} FROM levels""")
oracle("cs_rank", ("ranked",), f"""
    SELECT {KEYS}, {many(r, [c + '_cs_rank' for c in ('close_return_1', 'price_to_ma_20', 'volatility_10', 'open_volume_corr_20', 'turnover_rate', 'amplitude')])}
    FROM ranked""")
BASELINE = [
    *SHAPE, *STEPS,
    *windowed("close_return", "volume_return", "return_mean", "price_to_ma", "volatility", "volume_ratio", "high_breakout", "low_rebound", "range_position"),
    *[c + "_cs_rank" for c in RANKED[:6]],
    "turnover_rate", *windowed("turnover_ratio"), "turnover_rate_cs_rank", "log_amount", *windowed("amount_ratio"),
    "amplitude", "amplitude_cs_rank", "change_amount", "pct_chg", "pct_chg_cs_rank",
]
ALPHA = [
    "close_to_vwap", *[f"{p}_volume_corr_{w}" for w in (10, 20) for p in ("open", "close", "vwap")],
    "delta_price_to_ma_10_3", "close_to_vwap_cs_rank", "delta_price_to_ma_10_3_cs_rank", "open_volume_corr_20_cs_rank",
]
OTHERS = [
    *[m for m in MARKET_ALL if m in (
        "market_return_mean_1", "market_return_std_1", "market_up_ratio_1", "market_top_decile_return_1",
        "market_breadth_thrust_5", "market_dispersion_trend_5", "market_amount_top_share_1")],
    *EXCESS, *windowed("path_efficiency", "path_consistency"),
    *[f"{n}_{w}" for w in (5, 10) for n in ("positive_day_ratio", "win_loss_strength")],
    "squeeze_breakout_10", "breakout_stability_20", "recovery_quality_20", *[c + "_cs_rank" for c in RANKED[9:]],
]
oracle("feature_panel", ("ranked",), f"SELECT {KEYS}, {many(zero, [*BASELINE, *ALPHA])} FROM ranked")
oracle("full_panel", ("ranked",), f"SELECT {KEYS}, {many(zero, [*BASELINE, *ALPHA, *OTHERS])} FROM ranked")

# --- labels ---------------------------------------------------------------

cte("forward", ("bars",), f"""
    SELECT *, {ratio('open_t_sell', 'open_t_buy')} - 1 AS future_return FROM (
      SELECT *, lead(open, 1) OVER ({BY_ID}) AS open_t_buy, lead(open, 5) OVER ({BY_ID}) AS open_t_sell FROM bars)""")
cte("valid", ("forward",), "SELECT * FROM forward WHERE future_return IS NOT NULL AND open_t_buy > 0")
oracle("forward_return", ("forward",), f"SELECT {KEYS}, {many(r, ('open_t_buy', 'open_t_sell', 'future_return'))} FROM forward")
oracle("valid_samples", ("valid",), f"SELECT {KEYS}, {many(r, ('open_t_buy', 'future_return'))} FROM valid")


def clipped(q: float) -> str:
    return f"""SELECT v.*, least(greatest(future_return, lo), hi) AS clipped_return FROM valid v JOIN (
      SELECT trade_date, quantile_cont(future_return, {q}) AS lo, quantile_cont(future_return, 1 - {q}::DOUBLE) AS hi
      FROM valid GROUP BY 1) USING (trade_date)"""


cte("clipped05", ("valid",), clipped(0.05))
cte("clipped10", ("valid",), clipped(0.1))
oracle("clip_by_date", ("clipped05",), f"SELECT {KEYS}, {r('clipped_return')} FROM clipped05")
oracle("clip_overall", ("valid",), f"""
    SELECT {KEYS}, {r('least(greatest(future_return, lo), hi)', 'target')} FROM valid,
      (SELECT quantile_cont(future_return, 0.02) AS lo, quantile_cont(future_return, 1 - 0.02::DOUBLE) AS hi FROM valid)""")


def place(c: str) -> str:
    return f"row_number() OVER (PARTITION BY trade_date ORDER BY {c} DESC, stock_id) / (count(*) OVER (PARTITION BY trade_date))::DOUBLE"


def label(c: str) -> str:
    return f"floor(least(greatest((1 - {place(c)}) * 10, 0), 10 - 1e-6))"


oracle("relevance_label", ("valid",), f"SELECT {KEYS}, {i(label('future_return'), 'relevance_label')} FROM valid")
oracle("relevance_label_clipped", ("clipped10",), f"SELECT {KEYS}, {i(label('clipped_return'), 'relevance_label')} FROM clipped10")
cte("weighted", ("valid",), f"""
    SELECT *, CASE WHEN {place('future_return')} <= 0.2::DOUBLE THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS sample_weight,
      dense_rank() OVER (ORDER BY trade_date) - 1 AS qid, {label('future_return')} AS relevance_label FROM valid""")
oracle("head_weight", ("weighted",), f"SELECT {KEYS}, {r('sample_weight')} FROM weighted")
oracle("date_group", ("weighted",), f"SELECT {KEYS}, {i('qid')} FROM weighted")
oracle("group_weights", ("weighted",), f"""
    SELECT {i('qid')}, {r('avg(sample_weight)', 'group_weight')}, {i('count(*)', 'group_size')} FROM weighted GROUP BY qid""")
SOME = ("price_to_ma_20", "close_return_5", "volume_ratio_20", "price_to_ma_20_cs_rank")
oracle("ranking_panel", ("weighted", "ranked"), f"""
    SELECT w.stock_id, {d('w.trade_date', 'trade_date')}, {many(zero, SOME)}, {r('future_return')},
      {i('relevance_label')}, {r('sample_weight')}, {i('qid')}
    FROM weighted w JOIN ranked k ON w.stock_id = k.stock_id AND w.trade_date = k.trade_date""")
cte("latest", ("bars",), "SELECT stock_id, max(trade_date) AS trade_date FROM bars GROUP BY 1")
oracle("inference_panel", ("ranked", "latest"), f"""
    SELECT {KEYS}, {many(zero, SOME)}, 0.0::DOUBLE AS not_a_feature FROM ranked JOIN latest USING (stock_id, trade_date)""")
oracle("latest_row", ("bars", "latest"), f"SELECT {KEYS}, {r('open')}, {r('close')} FROM bars JOIN latest USING (stock_id, trade_date)")
oracle("last_rows", ("bars",), f"""
    SELECT {KEYS}, {r('open')}, {r('close')} FROM bars
    QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 5""")

# --- splits ---------------------------------------------------------------

cte("bar_dates", ("bars",), "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM bars)")
cte("dates", ("valid",), "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM valid)")
SIZE = "greatest(1, round_even(n * 0.1::DOUBLE, 0)::BIGINT)"
oracle("hold_out", ("bar_dates",), f"""
    SELECT {d('trade_date')}, CASE WHEN i >= n - least({SIZE}, n - 252) THEN 'valid' ELSE 'train' END AS role FROM bar_dates""")


def folds(source: str, count: int, minimum: int, purge: int) -> str:
    return f"""
    SELECT * FROM (
      SELECT *, CASE WHEN i < vs - {purge} THEN 'train' WHEN i >= vs AND i < ve THEN 'valid' END AS role FROM (
        SELECT *, ve - size AS vs FROM (
          SELECT *, n - (k - fold - 1) * size AS ve FROM (
            SELECT *, unnest(range(0, k)) AS fold FROM (
              SELECT *, least({count}, (n - {minimum} - {purge}) // size) AS k FROM (
                SELECT *, {SIZE} AS size FROM {source})))))
    ) WHERE role IS NOT NULL AND vs - {purge} >= {minimum}"""


cte("purged", ("dates",), folds("dates", 4, 200, 5))
oracle("purged_folds", ("purged",), f"SELECT {d('trade_date')}, {i('fold')}, role FROM purged")
oracle("walk_forward_folds", ("bar_dates",), f"""
    SELECT {d('trade_date')}, {i('fold')}, role FROM (
      SELECT *, CASE WHEN i < vs THEN 'train' WHEN i < ve THEN 'valid' END AS role FROM (
        SELECT *, greatest(200, ve - size) AS vs FROM (
          SELECT *, n - (k - fold - 1) * size AS ve FROM (
            SELECT *, unnest(range(0, k)) AS fold FROM (
              SELECT *, least(4, greatest(1, (n - 200) // size)) AS k FROM (SELECT *, {SIZE} AS size FROM bar_dates))))))
    WHERE role IS NOT NULL""")
cte("outer_train", ("purged",), """
    SELECT trade_date, fold AS outer_fold, row_number() OVER (PARTITION BY fold ORDER BY trade_date) - 1 AS i,
      count(*) OVER (PARTITION BY fold) AS n FROM purged WHERE role = 'train'""")
cte("nested", ("outer_train",), folds("outer_train", 3, 126, 5))
oracle("nested_folds", ("nested",), f"SELECT {i('outer_fold')}, {d('trade_date')}, {i('fold', 'inner_fold')}, role FROM nested")
oracle("clip_overall_sketched", ("valid", "purged"), f"""
    SELECT {i('fold')}, role, {i('count(*)', 'rows')}, 1::BIGINT AS low_within, 1::BIGINT AS high_within
    FROM valid JOIN purged USING (trade_date) GROUP BY fold, role""")
oracle("fold_rows", ("valid", "purged"), f"""
    SELECT {i('fold')}, role, {i('count(*)', 'rows')}, {d('min(trade_date)', 'first_date')}, {d('max(trade_date)', 'last_date')},
      {r('avg(future_return)', 'mean_return')} FROM valid JOIN purged USING (trade_date) GROUP BY fold, role""")
oracle("rebalance_dates", ("dates",), f"SELECT {d('trade_date')}, {i('i', 'date_index')} FROM dates WHERE i % 5 = 0")
oracle("date_membership", ("bars", "bar_dates", "latest"), f"""
    SELECT kind, {i('year(trade_date)', 'year')}, {i('count(*)', 'rows')} FROM (
      SELECT CASE WHEN i % 5 = 0 THEN 'on' ELSE 'off' END AS kind, trade_date FROM bars JOIN bar_dates USING (trade_date)
      UNION ALL SELECT 'instrument', trade_date FROM bars WHERE stock_id IN (
        SELECT stock_id FROM bars JOIN latest USING (stock_id, trade_date) WHERE close > open))
    GROUP BY 1, 2""")

# --- scores ---------------------------------------------------------------

cte("labelled", ("valid", "ranked"), """
    SELECT v.stock_id, v.trade_date, v.future_return, coalesce(k.price_to_ma_20, 0) AS ranker_a,
      coalesce(k.close_return_5, 0) AS ranker_b, coalesce(k.volume_ratio_20, 0) AS regressor,
      coalesce(k.price_to_ma_20_cs_rank, 0) AS pred_score
    FROM valid v JOIN ranked k ON v.stock_id = k.stock_id AND v.trade_date = k.trade_date""")


def z(c: str, over: str = "") -> str:
    sd = f"stddev_pop({c}) OVER ({over})"
    return f"CASE WHEN {sd} > {EPS} THEN ({c} - avg({c}) OVER ({over})) / {sd} ELSE 0 END"


def mean_rank(c: str, part: str = "") -> str:
    tie = f"{part}, {c}" if part else f"PARTITION BY {c}"
    return f"(rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE) / count(*) OVER ({part})"


def centred(c: str, part: str = "") -> str:
    # The mean of average-tie ranks over n rows is (n + 1) / 2n.
    n = f"count(*) OVER ({part})"
    return f"{mean_rank(c, part)} - ({n} + 1) / (2.0::DOUBLE * {n})"


oracle("zscore", ("labelled",), f"""
    SELECT {KEYS}, {', '.join(r(z(m), 'z_' + m) for m in MODELS)},
      {r(z('ranker_a', 'PARTITION BY trade_date'), 'z_ranker_a_in_date')} FROM labelled""")
oracle("centred_rank", ("labelled",), f"SELECT {KEYS}, {', '.join(r(centred(m), 'c_' + m) for m in MODELS)} FROM labelled")
oracle("zscore_ensemble", ("labelled",), f"""
    SELECT {KEYS}, {r('(' + ' + '.join(f'({z(m)})' for m in MODELS) + ') / 3', 'pred_score')} FROM labelled""")
cte("fold_scores", ("labelled", "purged"), "SELECT l.*, fold FROM labelled l JOIN purged p USING (trade_date) WHERE role = 'valid'")
FOLD = "PARTITION BY fold"
oracle("rank_average", ("fold_scores",), f"""
    SELECT {i('fold')}, {KEYS}, {r('(' + ' + '.join(f'({centred(m, FOLD)})' for m in MODELS) + ') / 3', 'pred_score')} FROM fold_scores""")


def metrics(source: str, by: str, k: int) -> str:
    """Top-k return metrics of (by, trade_date, stock_id, pred_score, future_return) rows."""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    day = f"PARTITION BY {keys}trade_date"
    rounded = ", ".join(f"round({m}, 8) AS {m}" for m in METRICS)
    return f"""
    SELECT {keys}{rounded}, evaluated_week_count FROM (SELECT *, CASE WHEN abs(oracle_top_k_return_mean - baseline_top_k_return_mean) > {EPS}
        THEN (pred_top_k_return_mean - baseline_top_k_return_mean) / (oracle_top_k_return_mean - baseline_top_k_return_mean)
        ELSE 0 END AS top_k_relative_score FROM (
      SELECT {keys}avg(p) AS pred_top_k_return_mean, quantile_cont(p, 0.5) AS pred_top_k_return_median,
        stddev_pop(p) AS pred_top_k_return_std, avg(CASE WHEN p > 0 THEN 1.0::DOUBLE ELSE 0 END) AS pred_top_k_positive_rate,
        quantile_cont(p, 0.1) AS pred_top_k_q10, avg(p) FILTER (tail <= ceil(weeks * 0.1::DOUBLE)) AS pred_top_k_cvar10,
        min(p) AS pred_top_k_worst, avg(o) AS oracle_top_k_return_mean, avg(b) AS baseline_top_k_return_mean,
        count(*) AS evaluated_week_count
      FROM (
        SELECT *, row_number() OVER ({part} ORDER BY p, trade_date) AS tail, count(*) OVER ({part}) AS weeks FROM (
          SELECT {keys}trade_date, avg(future_return) FILTER (sp <= {k}) AS p, avg(future_return) FILTER (ro <= {k}) AS o,
            avg(future_return) AS b
          FROM (
            SELECT *, row_number() OVER ({day} ORDER BY pred_score DESC, stock_id) AS sp,
              row_number() OVER ({day} ORDER BY future_return DESC, stock_id) AS ro,
              dense_rank() OVER ({part} ORDER BY trade_date) - 1 AS di FROM {source})
          WHERE di % 5 = 0 GROUP BY {keys}trade_date))
      {group}))"""


cte("long_scores", ("fold_scores",), " UNION ALL ".join(
    f"SELECT fold, trade_date, stock_id, future_return, '{m}' AS model, {m} AS pred_score FROM fold_scores" for m in MODELS))
cte("fold_metrics", ("long_scores",), metrics("long_scores", "fold, model", 5))
cte("fold_weights", ("fold_metrics",), f"""
    SELECT fold, model, CASE WHEN total <= {EPS} THEN 1.0::DOUBLE / m ELSE w / total END AS weight FROM (
      SELECT fold, model, w, sum(w) OVER ({FOLD}) AS total, count(*) OVER ({FOLD}) AS m
      FROM (SELECT fold, model, greatest(0, top_k_relative_score) AS w FROM fold_metrics))""")
oracle("model_evaluation", ("fold_metrics",), f"SELECT {i('fold')}, model, {many(r, METRICS)}, {i('evaluated_week_count')} FROM fold_metrics")
oracle("validation_weights", ("fold_weights",), f"SELECT {i('fold')}, model, {r('weight')} FROM fold_weights")
cte("wide_weights", ("fold_weights",), "SELECT fold, " + ", ".join(
    f"max(weight) FILTER (model = '{m}') AS w_{m}" for m in MODELS) + " FROM fold_weights GROUP BY fold")
oracle("weighted_ensemble", ("fold_scores", "wide_weights"), f"""
    SELECT {i('fold')}, {KEYS}, {r(' + '.join(f'z_{m} * w_{m}' for m in MODELS), 'pred_score')} FROM (
      SELECT *, {', '.join(f'{z(m, FOLD)} AS z_{m}' for m in MODELS)} FROM fold_scores) JOIN wide_weights USING (fold)""")
oracle("robust_model_scores", ("fold_metrics",), f"""
    SELECT model, {r('CASE WHEN ret <= 0 THEN least(rel, 0) ELSE rel END', 'score')} FROM (
      SELECT model, quantile_cont(top_k_relative_score, 0.5) AS rel, quantile_cont(pred_top_k_return_mean, 0.5) AS ret
      FROM fold_metrics GROUP BY 1)""")


def shrunk(source: str, by: str, shrinkage: float, cap: float, rounds: int = 9) -> str:
    """Water filling under the cap, one nested query per round."""
    c, part = f"{cap}::DOUBLE", f"PARTITION BY {by}"
    sql = f"""SELECT {by}, model, {shrinkage}::DOUBLE / count(*) OVER ({part}) + {1 - shrinkage}::DOUBLE *
        CASE WHEN sum(s) OVER ({part}) > 0 THEN s / sum(s) OVER ({part}) ELSE 1.0::DOUBLE / count(*) OVER ({part}) END AS w
      FROM (SELECT {by}, model, greatest(0, score) AS s FROM {source})"""
    for _ in range(rounds):
        sql = f"""SELECT {by}, model, x + a + CASE WHEN rest > {EPS} AND free > 0 THEN rest * room / free ELSE 0 END AS w FROM (
          SELECT *, excess - sum(a) OVER ({part}) AS rest FROM (
            SELECT *, CASE WHEN excess > 0 AND room > 0 THEN least(room, excess * CASE WHEN held > {EPS} THEN base / held ELSE room / free END) ELSE 0 END AS a FROM (
              SELECT *, sum(room) OVER ({part}) AS free, sum(base) OVER ({part}) AS held, sum(over_cap) OVER ({part}) AS excess FROM (
                SELECT *, CASE WHEN x < {c} - {EPS} THEN {c} - x ELSE 0 END AS room, CASE WHEN x < {c} - {EPS} THEN x ELSE 0 END AS base FROM (
                  SELECT *, CASE WHEN w > {c} + {EPS} THEN {c} ELSE w END AS x, CASE WHEN w > {c} + {EPS} THEN w - {c} ELSE 0 END AS over_cap
                  FROM ({sql}))))))"""
    return f"SELECT {by}, model, least(w, {c}) / sum(least(w, {c})) OVER ({part}) AS weight FROM ({sql})"


cte("return_scores", ("fold_metrics",), "SELECT fold, model, round(pred_top_k_return_mean, 8) AS score FROM fold_metrics")
oracle("shrunk_weights", ("return_scores",), f"""
    SELECT {i('fold')}, model, {r('weight')} FROM ({shrunk('return_scores', 'fold', 0.2, 0.4)})""")
FRAME_WEIGHTS = {"ranker_a": 0.5, "ranker_b": 0.3, "regressor": 0.2}
oracle("rank_ensemble", ("labelled",), f"""
    SELECT {KEYS}, {r(' + '.join(f'{w}::DOUBLE * {mean_rank(m)}' for m, w in FRAME_WEIGHTS.items()), 'pred_score')} FROM labelled""")
oracle("rank_ensemble_by_date", ("labelled",), f"""
    SELECT {KEYS}, {r('(' + ' + '.join(mean_rank(m, 'PARTITION BY trade_date') for m in MODELS) + ') / 3', 'pred_score')} FROM labelled""")
oracle("zscore_overlay", ("labelled",), f"""
    SELECT {KEYS}, {r(f"{z('ranker_a')} + 0.7::DOUBLE * {z('regressor')}", 'pred_score')} FROM labelled""")

# --- picks and portfolio --------------------------------------------------

oracle("topk_picks", ("labelled",), f"""
    SELECT {d('trade_date')}, stock_id, {r('CASE WHEN place = n THEN round(1 - round(1.0::DOUBLE / n, 6) * (n - 1), 6) ELSE round(1.0::DOUBLE / n, 6) END', 'weight')},
      {i('place')}
    FROM (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM (
      SELECT trade_date, stock_id, row_number() OVER (PARTITION BY trade_date ORDER BY pred_score DESC, stock_id) AS place FROM labelled)
      WHERE place <= 3)""")
oracle("picks_round_trip", ("labelled",), f"""
    SELECT {d('trade_date')}, stock_id, {r('CASE WHEN place = n THEN round(1 - round(1.0::DOUBLE / n, 6) * (n - 1), 6) ELSE round(1.0::DOUBLE / n, 6) END', 'weight')}
    FROM (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM (
      SELECT trade_date, stock_id, row_number() OVER (PARTITION BY trade_date ORDER BY pred_score DESC, stock_id) AS place FROM labelled)
      WHERE place <= 3)""")
cte("history", ("bars",), f"SELECT stock_id, trade_date, close, row_number() OVER ({BY_ID}) AS seq FROM bars WHERE close > 0")
cte("eligible", ("labelled", "history"), """
    SELECT l.*, seq FROM labelled l JOIN history h USING (stock_id, trade_date) WHERE seq >= 61""")
oracle("eligible_rows", ("eligible",), f"SELECT {KEYS}, {r('pred_score')}, {i('seq')} FROM eligible")


def pool(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""
    SELECT *, count(*) OVER (PARTITION BY {keys}trade_date) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys}trade_date ORDER BY pred_score DESC, stock_id) AS place FROM {source})
    WHERE place <= 15 QUALIFY count(*) OVER (PARTITION BY {keys}trade_date) >= 5"""


cte("weeks", ("eligible", "dates"), "SELECT e.* FROM eligible e JOIN dates USING (trade_date) WHERE i % 5 = 0")
cte("pool", ("weeks",), pool("weeks"))
cte("short", ("pool", "dates"), "SELECT trade_date FROM dates WHERE i % 5 = 0 AND trade_date NOT IN (SELECT trade_date FROM pool)")


def and_short(columns: str, nulls: int, reason: str = "NULL::VARCHAR", short: str = "short", listed: bool = False) -> str:
    """The rows with their reason, then one row of NULLs for each short date; columns stand after the date, a shown list first."""
    return f"""SELECT {d('trade_date')}, {columns}, {reason} AS degraded_reason FROM {{}}
      UNION ALL SELECT {d('trade_date')}, {(chr(39) * 2 + ', ') * listed}{'NULL, ' * (nulls - listed)}'too few eligible instruments' FROM {short}"""


oracle("candidate_pool", ("pool", "short"), and_short(f"stock_id, {r('pred_score')}, {i('place')}, {i('n', 'candidates')}", 4).format("pool"))


def grid_returns(source: str, by: str = "") -> str:
    """Pivot on the pool's own dates, carried forward, last 61 dates, simple returns."""
    keys = f"{by}, " if by else ""
    k = f"{keys}trade_date"
    return f"""
    SELECT {k}, place, back AS day, coalesce(c / nullif(p, 0) - 1, 0) AS daily_return FROM (
      SELECT {k}, place, back, days, c, lag(c) OVER (PARTITION BY {k}, place ORDER BY back DESC) AS p FROM (
        SELECT {k}, place, back, days, last_value(close IGNORE NULLS) OVER (PARTITION BY {k}, place ORDER BY back DESC
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
        FROM (
          SELECT g.*, q.place, h.close FROM (
            SELECT {k}, hd, row_number() OVER (PARTITION BY {k} ORDER BY hd DESC) AS back, count(*) OVER (PARTITION BY {k}) AS days FROM (
              SELECT DISTINCT {', '.join('q.' + x.strip() for x in k.split(','))}, h.trade_date AS hd
              FROM {source} q JOIN history h ON h.stock_id = q.stock_id AND h.trade_date <= q.trade_date)) g
          JOIN {source} q USING ({k})
          LEFT JOIN history h ON h.stock_id = q.stock_id AND h.trade_date = g.hd)))
    WHERE back <= 60 AND back < days"""


def covariance(source: str, by: str = "") -> str:
    k = f"{by}, trade_date" if by else "trade_date"
    ka = ", ".join("a." + x.strip() for x in k.split(","))
    return f"""
    SELECT {k}, i, j, cov AS covariance, CASE WHEN i = j THEN 1 ELSE cov / (sqrt(greatest(si, 1e-18)) * sqrt(greatest(sj, 1e-18))) END AS correlation
    FROM (
      SELECT *, max(CASE WHEN i = j THEN cov END) OVER (PARTITION BY {k}, i) AS si,
        max(CASE WHEN i = j THEN cov END) OVER (PARTITION BY {k}, j) AS sj FROM (
        SELECT {k}, i, j, (1 - share) * s + CASE WHEN i = j THEN share * m ELSE 0 END AS cov FROM (
          SELECT *, CASE WHEN beta = 0 THEN 0 ELSE beta / delta END AS share FROM (
            SELECT *, least((fourth / 60 - dd) / (p * 60), delta) AS beta FROM (
              SELECT *, (dd - 2 * m * tr + p * m * m) / p AS delta FROM (
                SELECT *, tr / p AS m FROM (
                  SELECT *, sum(s) FILTER (i = j) OVER (PARTITION BY {k}) AS tr, sum(s * s) OVER (PARTITION BY {k}) AS dd,
                    max(i) OVER (PARTITION BY {k}) AS p, sum(f4) OVER (PARTITION BY {k}) AS fourth FROM (
                    SELECT {ka}, a.place AS i, b.place AS j, sum(a.x * b.x) / 60 AS s, sum(a.x * a.x * b.x * b.x) AS f4
                    FROM x{source} a JOIN x{source} b USING ({k}, day) GROUP BY ALL HAVING count(*) = 60))))))))"""


cte("returns", ("pool", "history"), grid_returns("pool"))
oracle("candidate_returns", ("returns", "short"), and_short(f"{i('place')}, {i('day')}, {r('daily_return')}", 3).format("returns"))
cte("xreturns", ("returns",), "SELECT *, daily_return - avg(daily_return) OVER (PARTITION BY trade_date, place) AS x FROM returns")
cte("cov", ("xreturns",), covariance("returns"))
oracle("ledoit_wolf", ("cov", "short"), and_short(f"{i('i')}, {i('j')}, {r('covariance')}, {r('correlation')}", 4).format("(SELECT * FROM cov WHERE i <= j)"))


def alike(c: str, k: str) -> str:
    """Percentile rank, 0.5 when every value is close to that of the first subset."""
    first = f"first_value({c}) OVER (PARTITION BY {k} ORDER BY places)"
    near = f"1e-8 + 1e-5 * abs({first})"
    over = f"OVER (PARTITION BY {k})"
    return (
        f"CASE WHEN max({c}) {over} - {first} <= {near} AND {first} - min({c}) {over} <= {near} THEN 0.5::DOUBLE "
        f"ELSE {mean_rank(c, f'PARTITION BY {k}')} END"
    )


def subsets(pool_name: str, cov_name: str, by: str = "") -> str:
    k = f"{by}, trade_date" if by else "trade_date"
    on = lambda a, b: " AND ".join(f"{a}.{x.strip()} = {b}.{x.strip()}" for x in k.split(","))
    pk = ", ".join("p1." + x.strip() for x in k.split(","))
    joins = " ".join(f"JOIN {pool_name} p{n} ON {on('p1', f'p{n}')} AND p{n}.place > p{n - 1}.place" for n in range(2, 6))
    names = [x.strip() for x in k.split(",")]
    return f"""
    SELECT s.*, {alike('variance', k)} AS vr, {alike('mean_correlation', k)} AS cr FROM (
      SELECT {', '.join('t.' + x for x in names)}, t.sid, any_value(t.places) AS places, any_value(t.ids) AS ids, any_value(t.ms) AS mean_score,
        any_value(t.ret) AS ret,
        sum(CASE WHEN c.i = c.j THEN c.covariance ELSE 2 * c.covariance END) / 25 AS variance,
        sum(c.correlation) FILTER (c.i < c.j) / 10 AS mean_correlation
      FROM (SELECT {pk}, row_number() OVER () AS sid, [p1.place, p2.place, p3.place, p4.place, p5.place] AS places,
          [p1.stock_id, p2.stock_id, p3.stock_id, p4.stock_id, p5.stock_id] AS ids,
          (p1.pred_score + p2.pred_score + p3.pred_score + p4.pred_score + p5.pred_score) / 5 AS ms,
          (p1.future_return + p2.future_return + p3.future_return + p4.future_return + p5.future_return) / 5 AS ret
        FROM {pool_name} p1 {joins}) t
      JOIN {cov_name} c ON {on('t', 'c')} AND c.i <= c.j AND list_contains(t.places, c.i) AND list_contains(t.places, c.j)
      GROUP BY {', '.join('t.' + x for x in names)}, t.sid) s"""


cte("subsets", ("pool", "cov"), subsets("pool", "cov"))
oracle("subset_search", ("subsets", "short"), and_short(
    f"array_to_string(places, ',') AS places, {r('mean_score')}, {r('variance')}, {r('mean_correlation')}, {r('vr', 'variance_rank')}, {r('cr', 'correlation_rank')}", 6, listed=True
).format("subsets"))


def best(source: str, v: str, c: str, by: str = "") -> str:
    k = f"{by}, trade_date" if by else "trade_date"
    objective = f"mean_score - {v} * vr - {c} * cr"
    extra = f", {v} AS variance_penalty, {c} AS correlation_penalty"
    part = f"{k}, {v}, {c}" if not v[0].isdigit() else k
    return f"""SELECT *, {objective} AS objective{extra if v[0].isdigit() else ''} FROM {source}
      QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY {objective} DESC, ids) = 1"""


cte("chosen", ("subsets",), best("subsets", "0.5::DOUBLE", "0.25::DOUBLE"))
oracle("portfolio_selection", ("chosen", "short"), and_short("stock_id, 0.2::DOUBLE AS weight", 2).format("(SELECT trade_date, unnest(ids) AS stock_id FROM chosen)"))
cte("light", ("subsets",), best("subsets", "0.25::DOUBLE", "0.1::DOUBLE"))
# Pools of candidates with 21 closes; the early ones have no covariances.
cte("weeks20", ("labelled", "history", "dates"), """
    SELECT l.*, seq FROM labelled l JOIN history h USING (stock_id, trade_date) JOIN dates USING (trade_date) WHERE seq >= 21 AND i % 5 = 0""")
cte("pool20", ("weeks20",), pool("weeks20"))
cte("returns20", ("pool20", "history"), grid_returns("pool20"))
cte("xreturns20", ("returns20",), "SELECT *, daily_return - avg(daily_return) OVER (PARTITION BY trade_date, place) AS x FROM returns20")
cte("cov20", ("xreturns20",), covariance("returns20"))
cte("subsets20", ("pool20", "cov20"), subsets("pool20", "cov20"))
cte("light20", ("subsets20",), best("subsets20", "0.25::DOUBLE", "0.1::DOUBLE"))
cte("short20", ("pool20", "dates"), "SELECT trade_date FROM dates WHERE i % 5 = 0 AND trade_date NOT IN (SELECT trade_date FROM pool20)")
cte("fallen20", ("light20", "pool20"), """
    SELECT trade_date, list_sort(ids) AS ids, variance, objective, NULL::VARCHAR AS reason FROM light20
    UNION ALL
    SELECT trade_date, list(stock_id ORDER BY stock_id), 0.0, avg(pred_score), 'covariance_fallback:insufficient common return history' FROM pool20
    WHERE place <= 5 AND trade_date NOT IN (SELECT trade_date FROM light20) GROUP BY trade_date""")
oracle("portfolio_fallback", ("fallen20", "short20"), and_short(
    f"array_to_string(ids, ',') AS stock_ids, {r('variance', 'portfolio_variance')}, {r('objective', 'selection_score')}", 3, "reason", "short20", listed=True
).format("fallen20"))


def series(chosen: str, base: str, by: str) -> str:
    """Adds baseline, excess and overlap; ``by`` are the run keys, ``base`` the per-date baseline join."""
    run = f"PARTITION BY {by}" if by else ""
    return f"""
    SELECT *, ret - base AS excess, coalesce(len(list_intersect(prev, ids)) / len(list_distinct(list_concat(prev, ids)))::DOUBLE, 1) AS jac
    FROM (SELECT c.*, base, lag(ids) OVER ({run} ORDER BY trade_date) AS prev FROM {chosen} c JOIN {base})"""


cte("baseline", ("labelled",), "SELECT trade_date, avg(future_return) AS base FROM labelled GROUP BY 1")
cte("light_series", ("light", "baseline"), series("light", "baseline USING (trade_date)", ""))
oracle("portfolio_series", ("light_series", "dates", "baseline"), f"""
    SELECT {d('trade_date')}, {r('variance_penalty')}, {r('correlation_penalty')}, array_to_string(list_sort(ids), ',') AS stock_ids,
      {r('ret', 'portfolio_return')}, {r('base', 'baseline_return')}, {r('excess', 'excess_return')},
      {r('variance', 'portfolio_variance')}, {r('mean_correlation')}, {r('objective', 'selection_score')},
      {r('jac', 'jaccard_vs_previous')}, NULL::VARCHAR AS degraded_reason FROM light_series
    UNION ALL
    SELECT {d('trade_date')}, 0.25, 0.1, '', NULL, {r('base', 'baseline_return')}, NULL, NULL, NULL, NULL, NULL,
      'too few eligible instruments' FROM dates JOIN baseline USING (trade_date)
    WHERE i % 5 = 0 AND trade_date NOT IN (SELECT trade_date FROM light_series)""")
cte("penalties", (), """
    SELECT v AS variance_penalty, c AS correlation_penalty FROM (SELECT unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS v),
      (SELECT unnest([0.0, 0.1, 0.25, 0.5])::DOUBLE AS c)""")
STATS = ("mean", "median", "std", "positive_rate", "q10", "cvar10", "worst", "baseline_mean", "mean_excess_return",
         "baseline_outperformance_rate", "mean_jaccard")


def board(series_name: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    run = f"{keys}variance_penalty, correlation_penalty"
    part = f"PARTITION BY {by}" if by else ""
    return f"""
    SELECT *, row_number() OVER ({part} ORDER BY robust_score DESC, mean DESC, cvar10 DESC,
        variance_penalty + correlation_penalty + cvar_penalty, variance_penalty, correlation_penalty, cvar_penalty) AS rank FROM (
      SELECT *, mean + cvar_penalty * least(cvar10, 0) AS robust_score FROM (
        SELECT {run}, count(*) AS week_count, avg(ret) AS mean, quantile_cont(ret, 0.5) AS median, stddev_pop(ret) AS std,
          avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS positive_rate, quantile_cont(ret, 0.1) AS q10,
          avg(ret) FILTER (tail <= ceil(weeks * 0.1::DOUBLE)) AS cvar10, min(ret) AS worst, avg(base) AS baseline_mean,
          avg(excess) AS mean_excess_return, avg(CASE WHEN excess > 0 THEN 1.0::DOUBLE ELSE 0 END) AS baseline_outperformance_rate,
          avg(jac) AS mean_jaccard, 0 AS degraded_week_count
        FROM (SELECT *, row_number() OVER (PARTITION BY {run} ORDER BY ret, trade_date) AS tail,
          count(*) OVER (PARTITION BY {run}) AS weeks FROM {series_name}) GROUP BY {run}),
        (SELECT unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS cvar_penalty))"""


cte("grid_choices", ("subsets", "penalties"), best("(SELECT * FROM subsets, penalties)", "variance_penalty", "correlation_penalty"))
cte("grid_series", ("grid_choices", "baseline"), series("grid_choices", "baseline USING (trade_date)", "variance_penalty, correlation_penalty"))
cte("board", ("grid_series",), board("grid_series"))
PENALTIES = ("variance_penalty", "correlation_penalty", "cvar_penalty")
oracle("risk_grid", ("board", "dates"), f"""
    SELECT {many(r, PENALTIES)}, {i('week_count')}, {many(r, STATS)}, {i('degraded_week_count')}, {r('robust_score')}, {i('rank')},
      (SELECT count(*) FROM dates WHERE i % 5 = 0) - week_count AS short_week_count FROM board""")
CHOICE = ("round(robust_score, 12) DESC, mean DESC, cvar10 DESC, variance_penalty + correlation_penalty + cvar_penalty, "
          "variance_penalty, correlation_penalty, cvar_penalty")
oracle("risk_choice", ("board",), f"""
    SELECT {many(r, (*PENALTIES, 'mean', 'cvar10', 'robust_score'))} FROM board ORDER BY {CHOICE} LIMIT 1""")
cte("fold_ensemble", ("fold_scores",), f"""
    SELECT * REPLACE (({' + '.join(mean_rank(m, FOLD) for m in MODELS)}) / 3 AS pred_score) FROM fold_scores""")
cte("fold_dates", ("fold_ensemble",), "SELECT *, row_number() OVER (PARTITION BY fold ORDER BY trade_date) - 1 AS di FROM (SELECT DISTINCT fold, trade_date FROM fold_ensemble)")
cte("fold_weeks", ("fold_ensemble", "fold_dates"), "SELECT e.* FROM fold_ensemble e JOIN fold_dates USING (fold, trade_date) WHERE di % 5 = 0")
cte("fold_eligible", ("fold_weeks", "history"), "SELECT w.* FROM fold_weeks w JOIN history USING (stock_id, trade_date) WHERE seq >= 61")
cte("fold_pool", ("fold_eligible",), pool("fold_eligible", "fold"))
cte("fold_returns", ("fold_pool", "history"), grid_returns("fold_pool", "fold"))
cte("xfold_returns", ("fold_returns",), "SELECT *, daily_return - avg(daily_return) OVER (PARTITION BY fold, trade_date, place) AS x FROM fold_returns")
cte("fold_cov", ("xfold_returns",), covariance("fold_returns", "fold"))
cte("fold_subsets", ("fold_pool", "fold_cov"), subsets("fold_pool", "fold_cov", "fold"))
cte("fold_choices", ("fold_subsets", "penalties"), best("(SELECT * FROM fold_subsets, penalties)", "variance_penalty", "correlation_penalty", "fold"))
cte("fold_baseline", ("fold_weeks",), "SELECT fold, trade_date, avg(future_return) AS base FROM fold_weeks GROUP BY 1, 2")
cte("fold_series", ("fold_choices", "fold_baseline"), series("fold_choices", "fold_baseline USING (fold, trade_date)", "fold, variance_penalty, correlation_penalty"))
cte("fold_board", ("fold_series",), board("fold_series", "fold"))
oracle("fold_risk_boards", ("fold_board",), f"""
    SELECT {i('fold')}, {many(r, PENALTIES)}, {i('week_count')}, {many(r, ('mean', 'cvar10', 'robust_score'))}, {i('rank')} FROM fold_board""")
oracle("final_risk", ("fold_board",), f"""
    SELECT {many(r, PENALTIES)}, {r('median_outer_rank')}, {r('mean_outer_robust_score')} FROM (
      SELECT {', '.join(PENALTIES)}, quantile_cont(rank, 0.5) AS median_outer_rank, avg(robust_score) AS mean_outer_robust_score
      FROM fold_board GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT fold) FROM fold_board))
    ORDER BY median_outer_rank, mean_outer_robust_score DESC, variance_penalty + correlation_penalty + cvar_penalty,
      variance_penalty, correlation_penalty, cvar_penalty LIMIT 1""")

# --- metrics and gates ----------------------------------------------------

oracle("topk_metrics", ("labelled",), f"SELECT {many(r, METRICS)}, {i('evaluated_week_count')} FROM ({metrics('labelled', '', 5)})")
cte("yearly", ("valid",), "SELECT trade_date, year(trade_date) AS year, avg(future_return) AS ret FROM valid GROUP BY ALL")
oracle("weekly_stats", ("yearly",), f"""
    SELECT {i('year')}, {i('count(*)', 'week_count')}, {r('avg(ret)', 'mean')}, {r('quantile_cont(ret, 0.5)', 'median')},
      {r('stddev_pop(ret)', 'std')}, {r('avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END)', 'positive_rate')},
      {r('quantile_cont(ret, 0.1)', 'q10')}, {r('avg(ret) FILTER (tail <= ceil(n * 0.1::DOUBLE))', 'cvar10')}, {r('min(ret)', 'worst')}
    FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY ret, trade_date) AS tail, count(*) OVER (PARTITION BY year) AS n FROM yearly)
    GROUP BY year""")
oracle("fold_summary", ("fold_metrics",), f"""
    SELECT model, {', '.join(r(f'avg({m})', m) for m in METRICS)}, {r('avg(evaluated_week_count)', 'evaluated_week_count')}
    FROM fold_metrics GROUP BY model""")
cte("overlay", ("fold_scores",), f"""
    SELECT * REPLACE ({z('ranker_a', FOLD)} + 0.7::DOUBLE * {z('regressor', FOLD)} AS pred_score), 'overlay_top1' AS strategy FROM fold_scores""")
cte("five", ("fold_scores", "fold_ensemble"), """
    SELECT * REPLACE (ranker_a AS pred_score), 'ranker_top5' AS strategy FROM fold_scores
    UNION ALL SELECT *, 'equal_rank_top5' FROM fold_ensemble""")
cte("strategies", ("overlay", "five"), f"SELECT * FROM ({metrics('overlay', 'fold, strategy', 1)}) UNION ALL SELECT * FROM ({metrics('five', 'fold, strategy', 5)})")
oracle("strategy_comparison", ("strategies",), f"""
    SELECT {i('fold')}, strategy, {many(r, METRICS)}, {i('evaluated_week_count')} FROM strategies""")
cte("gates", ("strategies",), """
    SELECT count(DISTINCT fold) AS folds, avg(m) FILTER (strategy = 'equal_rank_top5') AS mean,
      arg_max(m, fold) FILTER (strategy = 'equal_rank_top5') AS latest, min(w) FILTER (strategy = 'equal_rank_top5') AS worst,
      min(w) FILTER (strategy = 'overlay_top1') AS old FROM (
      SELECT fold, strategy, round(pred_top_k_return_mean, 8) AS m, round(pred_top_k_worst, 8) AS w FROM strategies)""")
oracle("backtest_gates", ("gates",), f"""
    SELECT {i('folds', 'fold_count')}, {i('0', 'wrong_purge_count')}, {r('mean', 'strategy_mean')}, {r('latest', 'latest_mean')},
      {r('worst', 'strategy_worst')}, {r('old', 'old_worst')},
      CASE WHEN folds <> 4 THEN 'wrong number of folds' WHEN mean <= 0 THEN 'mean return not positive'
        WHEN latest <= 0 THEN 'latest fold too low' WHEN worst <= old THEN 'worst week not better' END AS first_failure FROM gates""")
cte("picks", ("bars",), """
    SELECT stock_id, 0.2::DOUBLE AS weight FROM bars WHERE trade_date = (
      SELECT max(trade_date) FROM (SELECT trade_date FROM bars GROUP BY 1 HAVING count(*) >= 8))
    ORDER BY volume DESC, stock_id LIMIT 5""")
oracle("picks_check", ("picks", "bars"), f"""
    SELECT {i('count(*)', 'row_count')}, {i('count(DISTINCT stock_id)', 'unique_stock_count')}, {r('sum(weight)', 'weight_sum')},
      {i("count(*) FILTER (trim(stock_id) = '')", 'empty_id_count')}, {i('count(*) FILTER (weight IS NULL)', 'bad_weight_count')},
      {i('count(*) FILTER (weight < 0)', 'negative_weight_count')}, {i('count(*) FILTER (abs(weight - 0.2::DOUBLE) > 1e-12)', 'unequal_weight_count')},
      {i('count(*) FILTER (stock_id NOT IN (SELECT stock_id FROM bars))', 'unknown_id_count')}, NULL::VARCHAR AS first_failure FROM picks""")
oracle("normalized_inputs", ("bars", "picks"), f"""
    SELECT stock_id, {i('count(*)', 'bars')}, {r('max(weight)', 'weight')}, {r('sum(open)', 'open_sum')}
    FROM bars LEFT JOIN picks USING (stock_id) WHERE volume > 10 GROUP BY stock_id""")


def realised(source: str) -> str:
    return f"""SELECT count(*) AS matched, sum(ret * weight) AS score FROM {source} JOIN (
      SELECT stock_id, {ratio('arg_max(open, trade_date) - arg_min(open, trade_date)', 'arg_min(open, trade_date)')} AS ret FROM (
        SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 5) GROUP BY 1) USING (stock_id)"""


oracle("realised_score", ("picks", "bars"), f"SELECT {i('matched', 'matched_count')}, {r('score')} FROM ({realised('picks')})")
cte("dear", ("bars", "latest"), """
    SELECT stock_id, 0.2::DOUBLE AS weight FROM bars JOIN latest USING (stock_id, trade_date) ORDER BY close DESC, stock_id LIMIT 5""")
oracle("score_vs_baseline", ("picks", "dear", "bars"), f"""
    SELECT {r('c.score', 'current_score')}, {r('b.score', 'baseline_score')}, {r('c.score - b.score', 'delta_vs_baseline')},
      {i('c.score > b.score', 'rank_eligible')} FROM ({realised('picks')}) c, ({realised('dear')}) b""")

# --- quality --------------------------------------------------------------


def quality(source: str, minimum: int) -> str:
    cutoff = "DATE '2001-10-29'"
    bad = "coalesce(open <= 0 OR close <= 0 OR high < greatest(open, close, low) OR low > least(open, close, high), false)"
    return f"""
    SELECT *, CASE WHEN bad_id_count > 0 THEN 'instrument ids must have six digits' WHEN bad_date_count > 0 THEN 'unreadable trade_date'
        WHEN critical_missing_count > 0 THEN 'missing prices' WHEN duplicate_key_count > 0 THEN 'duplicate keys'
        WHEN invalid_ohlc_count > 0 THEN 'invalid OHLC' WHEN stock_count < {minimum} THEN 'too few instruments'
        WHEN date_max <> strftime({cutoff}, '%Y-%m-%d') THEN 'latest date is not the cutoff'
        WHEN latest_day_stock_count < {minimum} THEN 'too few instruments on the cutoff date'
        WHEN short_history_stock_count > 0 THEN 'short history' END AS first_failure FROM (
      SELECT {i('count(*)', 'row_count')}, {i('count(DISTINCT stock_id)', 'stock_count')}, {d('min(trade_date)', 'date_min')},
        {d('max(trade_date)', 'date_max')}, {i(f'count(DISTINCT stock_id) FILTER (trade_date = {cutoff})', 'latest_day_stock_count')},
        {i("count(*) FILTER (NOT regexp_matches(stock_id, '^[0-9]{6}$'))", 'bad_id_count')},
        {i('count(*) FILTER (trade_date IS NULL)', 'bad_date_count')},
        {i('count(trade_date) - count(DISTINCT CASE WHEN trade_date IS NOT NULL THEN (stock_id, trade_date) END)', 'duplicate_key_count')},
        {i(f'count(*) FILTER ({bad})', 'invalid_ohlc_count')},
        {i('count(*) FILTER (open IS NULL OR close IS NULL OR high IS NULL OR low IS NULL)', 'critical_missing_count')},
        {i('count(*) FILTER (gap)', 'suspended_metric_missing_count')},
        (SELECT {i('count(*) FILTER (n < 60)', 'n')} FROM (SELECT count(*) AS n FROM {source} GROUP BY stock_id)) AS short_history_stock_count
      FROM {source})"""


cte("checked_bars", ("bars",), "SELECT *, volume IS NULL OR amount IS NULL OR turnover_rate IS NULL OR pct_chg IS NULL AS gap FROM bars")
oracle("quality_report", ("checked_bars",), quality("checked_bars", 5))
cte("flawed", (), """
    SELECT lpad(CAST(l_suppkey AS VARCHAR), greatest(6, length(CAST(l_suppkey AS VARCHAR)))::INT, '0') AS stock_id,
      CASE WHEN l_returnflag <> 'R' THEN CAST(l_shipdate AS DATE) END AS trade_date, l_extendedprice AS open,
      CASE WHEN l_quantity > 1 THEN l_extendedprice END AS close, l_extendedprice * (1.05::DOUBLE - l_discount) AS high,
      l_extendedprice * (1.0::DOUBLE - l_tax) AS low, l_linestatus <> 'O' AS gap FROM lineitem""")
oracle("quality_of_lines", ("flawed",), quality("flawed", 300))



cte("rank_rows", ("labelled", "weighted"), """
    SELECT w.qid, l.stock_id, w.relevance_label AS label, l.pred_score AS score, pow(2.0::DOUBLE, w.relevance_label) - 1 AS gain
    FROM labelled l JOIN weighted w USING (stock_id, trade_date)""")


def ideal(k: int) -> str:
    return f"""SELECT qid, sum(gain / log2(p + 1)) AS ideal FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY label DESC, stock_id) AS p FROM rank_rows) WHERE p <= {k} GROUP BY qid"""


cte("placed_rows", ("rank_rows",), "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, stock_id) AS place FROM rank_rows")
cte("ideal30", ("rank_rows",), ideal(30))
cte("ideal5", ("rank_rows",), ideal(5))
oracle("ranker_ideal_gain", ("ideal30",), f"SELECT {i('qid')}, {r('ideal')} FROM ideal30")
oracle("ranker_ndcg", ("placed_rows", "ideal5"), f"""
    SELECT {r('avg(coalesce(reached / nullif(ideal, 0), 0))', 'ndcg')} FROM (
      SELECT qid, sum(gain / log2(place + 1)) AS reached FROM placed_rows WHERE place <= 5 GROUP BY qid) JOIN ideal5 USING (qid)""")
cte("rank_pairs", ("placed_rows", "ideal30"), """
    SELECT qid, low, high, wins * doubt * change AS pull, doubt * (1 - doubt) * change AS bend FROM (
      SELECT *, 1 / (1 + exp(wins * apart)) AS doubt FROM (
        SELECT a.qid, a.stock_id AS low, b.stock_id AS high, a.score - b.score AS apart,
          CASE WHEN a.label > b.label THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS wins,
          abs(a.gain - b.gain) * abs(1 / log2(a.place + 1) - 1 / log2(b.place + 1)) / ideal AS change
        FROM placed_rows a JOIN placed_rows b ON a.qid = b.qid AND b.place <= 30 AND b.place < a.place AND a.label <> b.label
        JOIN ideal30 d ON d.qid = a.qid))""")
oracle("ranker_gradients", ("placed_rows", "rank_pairs"), f"""
    SELECT {i('qid')}, stock_id, {r('coalesce(sum(pull), 0)', 'gradient')}, {r('coalesce(sum(bend), 0)', 'curvature')}
    FROM placed_rows LEFT JOIN (
      SELECT qid, low AS stock_id, pull, bend FROM rank_pairs UNION ALL SELECT qid, high, -pull, bend FROM rank_pairs) USING (qid, stock_id)
    GROUP BY qid, stock_id""")


def uniform(*parts: str) -> str:
    text = "concat_ws('|', " + ", ".join(parts) + ")"
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


def noisy(c: str, name: str) -> str:
    base = ("'42'", f"'{name}'", "stock_id", "strftime(trade_date, '%Y-%m-%d')")
    normal = f"sqrt(-2.0::DOUBLE * ln({uniform(*base, repr('1'))})) * cos(6.283185307179586::DOUBLE * {uniform(*base, repr('2'))})"
    spread = f"(coalesce(stddev_samp({c}) OVER (), 0) + 1e-12)"
    choice = uniform("'42'", f"'{name}'")
    return f"CASE WHEN {choice} < 0.7::DOUBLE THEN {c} + {normal} * 0.01::DOUBLE * {spread} ELSE {c} END"


NOISED = {"price_to_ma_20": "ranker_a", "close_return_5": "ranker_b", "volume_ratio_20": "regressor"}
oracle("feature_noise", ("labelled",), f"""
    SELECT {KEYS}, {', '.join(r(noisy(c, name), name) for name, c in NOISED.items())} FROM labelled""")

# The split paths have to give what the window paths give.
for _name in ("cs_rank", "relevance_label", "head_weight", "centred_rank", "rank_ensemble"):
    ORACLE[f"{_name}_split"] = ORACLE[_name]
ORACLE["alpha_preset_more_windows"] = ORACLE["feature_panel"]
