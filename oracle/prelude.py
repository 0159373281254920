"""Shared DuckDB CTEs: the derived views, indicators, tags, scores and signals in plain SQL."""

from __future__ import annotations

from sparkbars.params import BEST, Rules

S = "PARTITION BY sym ORDER BY d"


def over(expr: str, frame: str = "") -> str:
    return f"{expr} OVER ({S} {frame})"


def last(expr: str, n: int) -> str:
    return over(expr, f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")


def before(expr: str, n: int) -> str:
    return over(expr, f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")


def gate(agg: str, col: str, n: int, k: int) -> str:
    return f"CASE WHEN {last(f'count({col})', n)} >= {k} THEN {last(f'{agg}({col})', n)} END"


def t(cond: str) -> str:
    return f"coalesce({cond}, false)"


def ratio(a: str, b: str) -> str:
    return f"((2 * ({a}) + ({b})) // (2 * ({b})))"


WEEKLY = f"""
trades AS (SELECT l_suppkey AS sym, date_trunc('week', l_shipdate)::DATE AS d, round(l_extendedprice * 100)::BIGINT AS cents, l_quantity::BIGINT AS qty,
             ((isodow(l_shipdate) - 1) * (1::BIGINT << 54) + l_orderkey) * 8 + l_linenumber AS place
           FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0),
ticked AS (SELECT *, {ratio('cents', '100 * qty')} AS tick FROM trades),
weekly AS (SELECT sym, d, arg_min(tick, place) AS op, max(tick) AS hi, min(tick) AS lo, arg_max(tick, place) AS cl,
             sum(cents)::BIGINT AS cents, sum(qty)::BIGINT AS qty FROM ticked GROUP BY 1, 2)"""


def _as_bars(src: str) -> str:
    return (f"SELECT sym, d, op / 100.0::DOUBLE AS open, hi / 100.0::DOUBLE AS high, lo / 100.0::DOUBLE AS low, "
            f"cl / 100.0::DOUBLE AS close, qty::DOUBLE AS volume FROM {src}")


def _pull(col: str) -> str:
    return f"{ratio(f'9 * s + 100 * q * {col}', '1000 * q')} AS {col}"


BARS_RAW = WEEKLY + f",\nbars_raw AS ({_as_bars('weekly')})"
BARS = WEEKLY + f""",
trail AS (SELECT *, {last('sum(cents)', 10)}::BIGINT AS s, {last('sum(qty)', 10)}::BIGINT AS q FROM weekly),
pulled AS (SELECT sym, d, {_pull('op')}, {_pull('hi')}, {_pull('lo')}, {_pull('cl')}, qty FROM trail),
bars AS ({_as_bars('pulled')})"""
UNIVERSE = """
universe AS (SELECT s_suppkey AS sym, s_name AS name, n_name AS industry, r_name AS region, s_acctbal AS balance
             FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MARKET = """
market_daily AS (SELECT l_shipdate::DATE AS d, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS amv,
                   count(*) AS stock_count FROM lineitem GROUP BY 1)"""
INDEX = """
index_daily AS (SELECT o_orderdate::DATE AS d,
                  sum(round(o_totalprice * 100)::BIGINT)::BIGINT / count(*)::DOUBLE / 100.0::DOUBLE AS close
                FROM orders GROUP BY 1)"""

ROLL = f""",
base AS (SELECT *, {over('row_number()')} AS rn, abs(close - open) AS body, least(open, close) - low AS lower_shadow,
           high - greatest(open, close) AS upper_shadow, high - low AS amplitude,
           (close - low) / (high - low + 1e-8::DOUBLE) AS close_position FROM bars),
roll AS (SELECT *, {over('lag(open)')} AS prev_open, {over('lag(high)')} AS prev_high, {over('lag(low)')} AS prev_low,
           {over('lag(close)')} AS prev_close, {over('lag(volume)')} AS prev_volume,
           {over('lag(amplitude)')} AS prev_amplitude, {last('avg(close)', 14)} AS ma14, {last('avg(close)', 28)} AS ma28,
           {last('avg(close)', 57)} AS ma57, {last('avg(close)', 114)} AS ma114, {last('avg(volume)', 20)} AS volume_ma,
           {last('min(low)', 9)} AS low9, {last('max(high)', 9)} AS high9,
           {over('sum((high + low + close) / 3 * volume)', 'ROWS UNBOUNDED PRECEDING')} AS cum_pv,
           {over('sum(volume)', 'ROWS UNBOUNDED PRECEDING')} AS cum_volume,
           CASE WHEN {before('count(close)', 5)} >= 2 THEN {before('min(close)', 5)} END AS low_before5,
           {gate('min', 'close', 10, 5)} AS low10, {gate('min', 'close', 12, 6)} AS low12,
           {gate('avg', 'volume', 10, 5)} AS volume_ma10 FROM base),
row1 AS MATERIALIZED (SELECT *, (ma14 + ma28 + ma57 + ma114) / 4 AS yellow_line,
           greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS true_range,
           close / nullif(prev_close, 0) - 1 AS change, (close / nullif(prev_close, 0) - 1) * 100 AS daily_return,
           coalesce((close - low9) / (high9 - low9 + 1e-8::DOUBLE) * 100, 50) AS rsv,
           coalesce(cum_pv / nullif(cum_volume, 0), (high + low + close) / 3) AS vwap,
           coalesce(sign(close - prev_close), 0) * volume AS signed_volume FROM roll)"""

# Recurrences by definition: e(0) = x(0), e(t) = a*x(t) + (1-a)*e(t-1).
REC = """,
rec AS (
  SELECT sym, rn, close AS e10, close AS w, rsv AS k, rsv AS dd, close AS e12, close AS e26, 0.0::DOUBLE AS dea
    FROM row1 WHERE rn = 1
  UNION ALL
  SELECT sym, rn, e10, (2 * e10 + 9 * w) / 11 AS w, k, (k + 2 * dd) / 3 AS dd, e12, e26,
         (2 * (e12 - e26) + 8 * dea) / 10 AS dea
  FROM (SELECT b.sym, b.rn, (2 * b.close + 9 * r.e10) / 11 AS e10, r.w, (b.rsv + 2 * r.k) / 3 AS k, r.dd,
               (2 * b.close + 11 * r.e12) / 13 AS e12, (2 * b.close + 25 * r.e26) / 27 AS e26, r.dea
          FROM rec r JOIN row1 b ON b.sym = r.sym AND b.rn = r.rn + 1)),
row2 AS (SELECT b.*, round(r.w, 9) AS white_line, r.k AS k, r.dd AS dd, e12 - e26 AS macd_dif,
           dea AS macd_dea, (e12 - e26 - dea) * 2 AS macd_hist FROM row1 b JOIN rec r USING (sym, rn)),
row3 AS (SELECT *, least(greatest(3 * k - 2 * dd, 0), 100) AS j FROM row2)"""
NO_REC = """,
row3 AS (SELECT *, NULL::DOUBLE AS white_line, NULL::DOUBLE AS j, NULL::DOUBLE AS macd_hist FROM row1)"""

IND = f""",
lvl2 AS (SELECT *, {last('avg(true_range)', 14)} AS atr14,
           {over('sum(signed_volume)', 'ROWS UNBOUNDED PRECEDING')} AS obv, {over('lag(white_line)')} AS prev_white,
           {over('lag(yellow_line)')} AS prev_yellow, {over('lag(j)')} AS prev_j,
           {over('lag(daily_return)')} AS prev_return, {over('lag(yellow_line, 5)')} AS yellow_ago,
           {last('max(daily_return)', 30)} AS max_return30, {before('avg(daily_return)', 10)} AS mean_return_before10,
           {gate('min', 'macd_hist', 12, 6)} AS low_hist12 FROM row3),
ind AS (SELECT *, {over('lag(atr14)')} AS prev_atr, {over('lag(atr14, 2)')} AS prev2_atr, {last('avg(atr14)', 30)} AS atr30,
           {gate('min', 'obv', 10, 5)} AS low_obv10 FROM lvl2)"""


def base(raw: bool = False, rec: bool = True) -> str:
    """Views up to the indicator CTE ``ind``."""
    head = (BARS_RAW + ",\nbars AS (SELECT * FROM bars_raw)") if raw else BARS
    return head + ROLL + (REC if rec else NO_REC) + IND


def tags(r: Rules = BEST) -> str:
    """Tag, score and signal CTEs on top of ``ind``; the last one is called ``sig``."""
    micro = [n for n, on in (("above_vwap", r.micro_vwap), ("inside_bar", r.micro_inside),
                             ("range_shrink", r.micro_shrink), ("lower_wick", r.micro_wick)) if on]
    micro_ok = f" {'AND' if r.micro_all else 'OR'} ".join(micro) or "true"
    n = r.flow_lookback
    gate_sql = f"score >= {r.min_score} AND (score < {r.rising_from_score} OR rising) AND NOT (score = 3 AND eq_volume = 1 AND eq_j = 0)"
    if r.drop_weak_score4:
        gate_sql += " AND NOT (score = 4 AND eq_j = 1 AND eq_volume = 0 AND eq_candle = 1 AND eq_ma = 2)"
    structure = "anchor_recent AND support_ok" + (" AND micro_ok" if r.structure_micro else "") + (" AND flow_ok" if r.smart_money else "")
    v64 = ("signal_structure" if r.structure else "signal_v63") + (f" AND {gate_sql}" if r.quality else "")
    if r.support_gate:
        v64 += f" AND support_score >= {r.support_min}" + "".join(f" AND factor_{x}" for x in r.support_needs)
    weighted = " + ".join(f"factor_{x}::INT * {w}" for x, w in zip("abcde", r.support_weights))
    quality_code = "'J' || eq_j || 'V' || eq_volume || 'C' || eq_candle || 'M' || eq_ma"
    support_code = "'A' || factor_a::INT || 'B' || factor_b::INT || 'C' || factor_c::INT || 'D' || factor_d::INT"
    persist = " + eq_persist" if r.persist else ""
    return f""",
t1 AS (SELECT *, {t('white_line > yellow_line AND close > yellow_line')} AS trend_ok,
   {t(f'volume < volume_ma * {r.dry_volume} AND volume < prev_volume AND amplitude < prev_amplitude')} AS no_supply,
   {t(f'low <= yellow_line + {r.touch_band} * atr14 AND close > low AND lower_shadow > body * 1.5 AND volume < volume_ma * {r.test_volume}')} AS test_bar
   FROM ind),
t2 AS (SELECT *, no_supply OR test_bar AS dry, CASE WHEN no_supply OR test_bar THEN volume ELSE 0 END AS dry_volume FROM t1),
t3 AS (SELECT *, coalesce({before('bool_or(dry)', 3)}, true) AS dry_recent, {before('max(dry_volume)', 3)} AS dry_volume_max,
   {t('daily_return > 9.5')} OR {t('amplitude / (prev_close + 1e-8::DOUBLE) > 0.10')} AS lively FROM t2),
t4 AS (SELECT *, {last('bool_or(lively)', 20)} AS active,
   {t(f'max_return30 > atr30 / (close + 1e-8::DOUBLE) * {r.dragon_multiple}')} AS dragon,
   {t(f'close > open AND body / (amplitude + 1e-8::DOUBLE) > {r.body_share} AND close_position > {r.close_location} AND volume > volume_ma * {r.demand_vs_average} AND volume > dry_volume_max * {r.demand_vs_dry} AND close > greatest(prev_open, prev_close)')} AS demand_bar,
   {t(f'close > yellow_line - {r.support_band} * atr14')} AS in_support,
   {t(f'close <= yellow_line + {r.overshoot_band} * atr14')} AS not_over FROM t3),
t5 AS (SELECT *, trend_ok AND dry_recent AND demand_bar AND in_support AND not_over AND active AND dragon AS anchor FROM t4),
t6 AS (SELECT *, coalesce({before('bool_or(anchor)', r.window)}, true) AS anchor_recent, {t(f'j < {r.oversold}')} AS oversold,
   {t(f'volume < volume_ma * {r.quiet_volume}')} AS volume_quiet, {t(f'body / (close + 1e-8::DOUBLE) < {r.quiet_body}')} AS body_quiet,
   {t(f'close > yellow_line - {r.quiet_support} * atr14')} AS support_ok,
   {t(f'lower_shadow > body * {r.rebound_shadow}')} OR close > open OR {t('j > prev_j')} AS rebound_ok FROM t5),
t7 AS (SELECT *, anchor_recent AND oversold AND volume_quiet AND body_quiet AND support_ok AS signal_v60,
   anchor_recent::INT + oversold::INT + volume_quiet::INT + body_quiet::INT + support_ok::INT AS near_count,
   {t('close > vwap')} AS above_vwap, {t('high <= prev_high AND low >= prev_low')} AS inside_bar,
   {t('atr14 < prev_atr AND prev_atr < prev2_atr')} AS range_shrink,
   {t('lower_shadow > body * 0.8 AND volume / nullif(volume_ma, 0) < 0.9')} AS lower_wick,
   {t('volume < volume_ma * 0.85 AND close >= low_before5 - 0.5 * atr14')} AS calm,
   {t('low <= yellow_line + 0.8 * atr14 AND low >= yellow_line - 0.8 * atr14 AND close >= yellow_line - 0.1 * atr14')} AS touch,
   {t('lower_shadow > body * 1.5')} OR {t('close_position > 0.65')} OR {t('close > open AND volume < volume_ma * 0.8 AND body / (close + 1e-8::DOUBLE) < 0.03')} AS gather,
   {t('close > prev_close')} AS is_up, {t('close < prev_close')} AS is_down, volume / nullif(prev_volume, 0) AS vol_prev,
   coalesce(change, 0) AS chg, {last('max(close)', n)} AS high_n,
   {t('white_line > yellow_line AND prev_white <= prev_yellow')} AS crossed FROM t6),
t8 AS (SELECT *, {'signal_v60 AND rebound_ok' if r.rebound else 'signal_v60'} AS signal_v61, {micro_ok} AS micro_ok,
   {last('sum(calm::INT)', 2)} >= 2 AS factor_a, {t('close <= low10 * 1.01 AND obv > low_obv10 * 1.05')} AS factor_b,
   {t('close <= low10 * 1.01 AND volume < volume_ma10')} AS factor_b_volume,
   {last('sum(touch::INT)', 8)} >= 2 AS factor_c, {last('sum(gather::INT)', 3)} >= 1 AS factor_d,
   {t('close <= low12 * 1.01 AND macd_hist > low_hist12 + 1e-4::DOUBLE AND macd_hist < 0')} AS factor_e,
   {t(f'is_up AND chg >= {r.flow_up_return} AND vol_prev >= {r.flow_up_volume}')} AS f_up,
   {t(f'is_down AND vol_prev <= {r.flow_pullback_volume}')} AS f_dq,
   CASE WHEN is_up THEN volume * greatest(chg, 0) ELSE 0 END AS f_gain,
   CASE WHEN is_down THEN volume * -least(chg, 0) ELSE 0 END AS f_loss,
   {t(f'close >= high_n * {r.flow_near_high} AND is_down AND (prev_close - close) / nullif(prev_close, 0) >= {r.flow_heavy_drop} AND vol_prev >= {r.flow_heavy_volume}')} AS f_heavy,
   CASE WHEN j < {r.j_extreme} THEN 2 WHEN j < {r.j_low} THEN 1 ELSE 0 END AS eq_j,
   CASE WHEN volume / (volume_ma + 1e-8::DOUBLE) < {r.volume_extreme} THEN 2
        WHEN volume / (volume_ma + 1e-8::DOUBLE) < {r.volume_low} THEN 1 ELSE 0 END AS eq_volume,
   least({t(f'lower_shadow > body * {r.candle_shadow}')}::INT + {t(f'body / (close + 1e-8::DOUBLE) < {r.candle_body}')}::INT + (close > open)::INT, {r.candle_cap}) AS eq_candle,
   CASE WHEN white_line > yellow_line THEN 2 WHEN {last('bool_or(crossed)', r.cross_lookback)} THEN 1
        WHEN abs(white_line - yellow_line) < {r.converge_band} * atr14 THEN 1 ELSE 0 END AS eq_ma,
   CASE WHEN {t(f'{over("lag(near_count)")} >= {r.persist_conditions}')} OR {t(f'{over("lag(near_count, 2)")} >= {r.persist_conditions}')}
        THEN {r.persist_points} ELSE 0 END AS eq_persist,
   {t('yellow_line > yellow_ago')} AS rising FROM t7),
t9 AS (SELECT *, {'signal_v61 AND micro_ok' if r.micro else 'signal_v61'} AS signal_v63,
   {weighted} AS support_score,
   {last('sum(f_up::INT)', n)} >= 1 AS sm_strong_up,
   {last('sum(is_down::INT)', n)} = 0 OR {t(f"{last('sum(f_dq::INT)', n)} / nullif({last('sum(is_down::INT)', n)}, 0) >= {r.flow_pullback_share}")} AS sm_pullback_shrink,
   {last('sum(f_gain)', n)} >= {last('sum(f_loss)', n)} * {r.flow_dominance} AS sm_dominance,
   {last('sum(f_heavy::INT)', n)} <= {r.flow_heavy_days} AS sm_no_distribution FROM t8),
t10 AS (SELECT *, sm_strong_up::INT + sm_pullback_shrink::INT + sm_dominance::INT + sm_no_distribution::INT AS flow_score,
   CASE WHEN support_score >= {r.support_two} THEN 2 WHEN support_score >= {r.support_one} THEN 1 ELSE 0 END AS eq_support FROM t9),
t11 AS (SELECT *, flow_score >= {r.flow_min_score} AS flow_ok,
   least(greatest(eq_j + eq_volume + eq_candle + eq_ma + eq_support{persist}, 0), 8) AS score FROM t10),
t12 AS (SELECT *, {structure} AS signal_structure FROM t11),
sig AS (SELECT *, {v64} AS signal_v64, {quality_code if r.quality else support_code} AS factor_code, {support_code} AS support_code FROM t12)"""


def query(select: str, *parts: str) -> str:
    """Join CTE parts and a final SELECT into one statement."""
    ctes = ",\n".join(p.strip().lstrip(",").strip() for p in parts if p)
    return f"WITH RECURSIVE {ctes}\n{select}"
