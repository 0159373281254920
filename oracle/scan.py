from __future__ import annotations

from oracle.ledgers import half_even
from oracle.maintenance import LISTING
from oracle.market import ASOF, MOMENTUM, REGIME_CTE, WEEK_CTE, allow_abs
from oracle.prelude import MARKET, UNIVERSE, base, last, over, query, tags
from sparkbars.params import BEST as R


def listed(*pairs: tuple[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN {label} END" for cond, label in pairs)
    return f"list_filter([{items}], lambda v: v IS NOT NULL)"


def pf(fmt: str, *values: str) -> str:
    return f"printf('{fmt}', {', '.join(values)})"


CONTEXT = f"""
cx0 AS (SELECT *, (yellow_line - yellow_ago) / nullif(yellow_ago, 0) * 100 AS slope_pct, {over(f'lag(close, {R.industry_days})')} AS cp,
  {last("list(CASE WHEN anchor THEN strftime(d, '%m-%d') END)", R.window)} AS marks, {last('bool_or(anchor)', R.window + 1)} AS anchor_window,
  CASE WHEN volume_ma > 0 THEN volume / volume_ma ELSE 0 END AS vol_ratio, daily_return AS change_pct FROM sig),
cx AS (SELECT *, CASE WHEN slope_pct > 0.3 THEN '向上' WHEN slope_pct < -0.3 THEN '向下' ELSE '走平' END AS slope,
  CASE WHEN cp > 0 THEN close / cp - 1 END AS ret_n, array_to_string(list_filter(marks, lambda v: v IS NOT NULL), ',') AS sos_dates FROM cx0),
hits AS (SELECT * FROM cx WHERE signal_v64)"""
WYCKOFF = listed(
    ("anchor", "'SOS需求确认(主力入场)'"), ("no_supply", "'No Supply供应枯竭'"), ("test_bar", "'Test测试柱(需求保护)'"),
    (f"rn > {R.window} AND anchor_window AND NOT anchor", f"'近{R.window}日有SOS锚定(LPS回踩)'"),
    (f"j < {R.oversold}", pf("J=%.0f情绪冰点(超卖)", "j")))
VPA = listed(
    ("true", f"CASE WHEN vol_ratio < {R.quiet_volume} THEN {pf('缩量(%.1f%%均量=供应枯竭)', 'vol_ratio * 100')} ELSE {pf('量比%.2f', 'vol_ratio')} END"),
    (f"body / (close + 1e-8::DOUBLE) < {R.quiet_body}", "'小实体(多空平衡/拒绝下跌)'"), ("lower_shadow > body * 1.5", "'下影线支撑(需求托底)'"))
CANDLE = """CASE WHEN body < amplitude * 0.1 THEN '十字星(方向选择)' WHEN close > open AND close_position > 0.7 THEN '阳线收高(强势)'
 WHEN close < open AND lower_shadow > body * 2 THEN '锤子线(潜在反转)' WHEN close >= open THEN '阳线' ELSE '阴线' END"""
LABELS = f"CASE WHEN len({WYCKOFF}) = 0 THEN '标准潜伏信号' ELSE array_to_string({WYCKOFF}, ';') END"
TY, TW = "((close - yellow_line) / yellow_line * 100)", "((close - white_line) / white_line * 100)"
NEAR, AW = f"abs({TY}) <= 0.5", "close > white_line"
LONG_BUY = listed((f"{NEAR} AND close >= yellow_line * (1 - 0.5::DOUBLE / 100)", pf("回踩黄线%.2f(偏离%+.1f%%)", "yellow_line", TY)),
                  (f"NOT {AW} AND close < yellow_line AND j < 20", pf("超跌买(J=%.0f<20,跌破双线)", "j")))
LONG_SELL = listed((f"{AW} AND j > 80", pf("白线%.2f上方+J=%.0f>80", "white_line", "j")), (f"{TW} > 3.0", pf("正乖离过大(偏离白线%+.1f%%)", TW)))
SHORT_SELL = listed((f"{NEAR} AND NOT close > yellow_line", pf("触黄线阻力%.2f(偏离%+.1f%%)", "yellow_line", TY)),
                    ("close < white_line", pf("跌破白线%.2f", "white_line")), (f"j > 100 AND {AW}", pf("超买卖(J=%.0f>100)", "j")),
                    (f"{TW} > 3.0 AND {AW}", pf("正乖离过大(偏离白线%+.1f%%)", TW)))
SHORT_BUY = listed((f"NOT {AW}", pf("回落至白线%.2f下方", "white_line")),
                   (f"{NEAR} AND vol_ratio < 0.8", pf("黄线%.2f附近缩量止跌(量比%.1f)", "yellow_line", "vol_ratio")))
AMP = "(amplitude / close * 100)"
BLANK = "(rn <= 5 OR close <= 0 OR yellow_line <= 0 OR white_line <= 0)"
IDLE = f"({BLANK} OR {AMP} < 1.5)"


def joined(lst: str, default: str) -> str:
    return f"CASE WHEN len({lst}) = 0 THEN {default} ELSE array_to_string({lst}, ' | ') END"


ANCHOR = f"(CASE WHEN {NEAR} THEN yellow_line ELSE white_line END)"
MODE = f"CASE WHEN {IDLE} THEN '观望' WHEN slope = '向上' THEN '正T' ELSE '倒T' END"
ADVICE = f"""{MODE} AS t_mode, CASE WHEN {BLANK} THEN '走平' ELSE slope END AS t_slope,
 CASE WHEN {IDLE} THEN NULL WHEN slope = '向上' THEN {joined(LONG_BUY, pf('等待回踩黄线%.2f或超跌J<20', 'yellow_line'))}
   ELSE {joined(SHORT_BUY, pf('等待回落至白线%.2f下方或黄线%.2f缩量', 'white_line', 'yellow_line'))} END AS t_buy,
 CASE WHEN {IDLE} THEN NULL WHEN slope = '向上' THEN {joined(LONG_SELL, pf('等待反弹至白线%.2f上方且J>80', 'white_line'))}
   ELSE {joined(SHORT_SELL, pf('等待触黄线%.2f或跌破白线%.2f', 'yellow_line', 'white_line'))} END AS t_sell,
 CASE WHEN {BLANK} THEN NULL WHEN {IDLE} THEN {pf('振幅仅%.1f%%，不足1.5%%，摩擦成本过高', AMP)}
   WHEN slope = '向上' THEN {pf('跌破黄线1.5%%(%.2f)严格短线止损', 'yellow_line * (1 - 1.5::DOUBLE / 100)')}
   ELSE {pf('突破%.2f的1.5%%(%.2f)立即买回防卖飞', ANCHOR, f'{ANCHOR} * (1 + 1.5::DOUBLE / 100)')} END AS t_risk,
 round(CASE WHEN NOT {BLANK} THEN {AMP} END, 6) AS t_amplitude"""
PRIORITY = f"(score >= 8 OR {half_even('vol_ratio')} < 0.3 OR {half_even('close')} BETWEEN 10 AND 20) AND score <> 7"
STARS = "CASE WHEN score >= 7 THEN '★★★' WHEN score >= 5 THEN '★★☆' ELSE '★☆☆' END"
GATED = f"""
g0 AS (SELECT h.* EXCLUDE (score), h.score AS score_before, coalesce(p.allowed, false) AS bull, u.name, u.industry, coalesce(a.allow, true) AS industry_ok,
   round(h.ret_n, 4) AS ret4 FROM hits h LEFT JOIN permitted p ON p.d = h.d LEFT JOIN universe u ON u.sym = h.sym
   LEFT JOIN allowed a ON a.industry = u.industry AND a.d = h.d),
g1 AS (SELECT *, coalesce(ret4 > CASE WHEN bull THEN {R.momentum_floor_bull} ELSE {R.momentum_floor} END, false) AS momentum_ok FROM g0),
gated AS (SELECT *, CASE WHEN momentum_ok THEN least(score_before + {R.momentum_boost}, 8) ELSE score_before END AS score,
   CASE WHEN ret4 IS NULL THEN '' WHEN momentum_ok THEN {pf('动量%+.1f%%', 'ret_n * 100')} ELSE {pf('动量不足%+.1f%%', 'ret_n * 100')} END AS momentum_tag FROM g1)"""
EXCEPTION = (f"{str(R.score4_exception).lower()} AND score = 4 AND round(j, 1) < {R.score4_j_max} AND {half_even('vol_ratio')} < {R.score4_volume_max}")
FINAL = (f"industry_ok AND momentum_ok AND round(j, 1) < {R.j_cap} AND CASE WHEN bull THEN score >= {R.bull_min_score} OR ({EXCEPTION}) "
         f"ELSE score >= {R.bear_min_score} END")


def oracle_sql() -> dict[str, str]:
    o = {}
    sig = [base(), tags(R), CONTEXT]
    full = [base(), tags(R), CONTEXT, UNIVERSE, MARKET, REGIME_CTE, WEEK_CTE, ASOF, MOMENTUM(R.industry_days), allow_abs(R.industry_threshold), GATED]
    o["signal_change_volratio"] = query("SELECT sym, d, round(change_pct, 6) AS change_pct, round(vol_ratio, 6) AS vol_ratio FROM cx", *sig)
    o["sos_dates_list"] = query("SELECT sym, d, sos_dates FROM cx", *sig)
    o["signal_detail_labels"] = query(f"""SELECT sym, d, {LABELS} AS wyckoff, array_to_string({VPA}, ';') AS vpa, {CANDLE} AS candle,
      round(yellow_line - 0.5 * atr14, 8) AS support, round(yellow_line + 1.5 * atr14, 8) AS resistance FROM hits""", *sig)
    more_vpa = f"list_concat({VPA}, CASE WHEN upper_shadow > body * 1.5 THEN ['上影线压力(供应出现)'] ELSE [] END)"
    more_candle = CANDLE.replace("WHEN close > open AND close_position", "WHEN body < amplitude * 0.3 AND close > open THEN '小阳线(温和看多)' "
                                 "WHEN body < amplitude * 0.3 THEN '小阴线(温和看空)' WHEN close > open AND close_position")
    o["signal_detail_extended"] = query(f"""SELECT sym, d, {LABELS} AS wyckoff, array_to_string({more_vpa}, ';') AS vpa, {more_candle} AS candle,
      round(yellow_line - 0.5 * atr14, 8) AS support, round(yellow_line + 1.5 * atr14, 8) AS resistance FROM hits""", *sig)
    o["t_trading_advice"] = query(f"SELECT sym, d, {ADVICE} FROM hits", *sig)
    o["signal_priority_tier"] = query(f"SELECT sym, d, score, {PRIORITY} AS priority, {STARS} AS stars FROM hits", *sig)
    o["seasonal_flag"] = query("SELECT d, CASE WHEN month(d) IN (3, 5) THEN 'danger' WHEN month(d) IN (8, 10) THEN 'golden' ELSE 'neutral' END AS season FROM market_daily", MARKET)
    rounded = {"price": "close", "white_line": "white_line", "yellow_line": "yellow_line", "j": "j", "atr14": "atr14",
               "change_pct": "change_pct", "vol_ratio": "vol_ratio", "stock_ret_n": "ret_n"}
    o["signal_record"] = query(f"""SELECT sym, u.name, u.industry, d, {', '.join(f'round({v}, 4) AS {k}' for k, v in rounded.items())}, sos_dates,
      score, eq_j, eq_volume, eq_candle, eq_ma, flow_score, flow_ok, round(close * 0.95::DOUBLE, 4) AS hard_stop,
      round(close - 3 * atr14, 4) AS chandelier_init, support_score, factor_a, factor_b, factor_c, factor_d, {MODE} AS t_mode, {PRIORITY} AS priority
      FROM hits LEFT JOIN universe u USING (sym)""", *sig, UNIVERSE)
    o["momentum_boost"] = query("SELECT sym, d, bull, momentum_ok, momentum_tag, score_before, score FROM gated", *full)
    o["momentum_hard_filter"] = query("SELECT sym, d, score FROM gated WHERE momentum_ok", *full)
    o["signal_revival"] = query(f"""SELECT sym, d, score, industry_ok, momentum_ok FROM gated WHERE (industry_ok AND momentum_ok)
      OR (NOT industry_ok AND score_before >= {R.revive_industry_score})
      OR (industry_ok AND NOT momentum_ok AND score_before >= {R.revive_momentum_score} AND eq_j >= {R.revive_j_score})""", *full)
    o["dynamic_score_filter"] = query(f"SELECT sym, d, bull, score FROM gated WHERE {FINAL}", *full)
    shown = f"sym, name, industry, d, round(close, 4) AS price, score, momentum_tag, {PRIORITY} AS priority, {STARS} AS stars, {LABELS} AS wyckoff"
    o["daily_scan"] = query(f"SELECT {shown} FROM gated WHERE {FINAL} AND (sym, d) IN (SELECT sym, max(d) FROM bars WHERE d <= DATE '1996-08-05' GROUP BY 1) "
                            "AND sym IN (SELECT sym FROM tradable)", *full, LISTING)
    o["daily_scans"] = query(f"""SELECT as_of, {shown} FROM gated JOIN
      (SELECT as_of, sym, max(d) AS d FROM bars JOIN (SELECT DISTINCT d AS as_of FROM bars WHERE d BETWEEN DATE '1996-01-01' AND DATE '1997-12-29') ON d <= as_of GROUP BY 1, 2)
      USING (sym, d) WHERE {FINAL} AND sym IN (SELECT sym FROM tradable)""", *full, LISTING)
    o["scan_all_dates"] = query(f"SELECT {shown} FROM gated WHERE {FINAL}", *full)
    return o
