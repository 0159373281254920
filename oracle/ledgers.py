from __future__ import annotations

from oracle.market import MOMENTUM, REGIME_CTE, allow_abs, allow_rs
from oracle.prelude import INDEX, MARKET, UNIVERSE, base, last, over, query, tags
from sparkbars.params import BEST, V60, V61, V63, V64, Rules
from sparkbars.plans.ledgers import FLOW, LEDGERS


def lots(x: str) -> str:
    return f"(floor(({x}) / 100) * 100)"


def case_map(expr: str, mapping, default) -> str:
    if not mapping:
        return str(default)
    return "CASE " + " ".join(f"WHEN {expr} = {k} THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


def stops(r: Rules, src: str, out: str) -> str:
    n = r.dynamic_lookback + 1

    def pick(default, choice):
        if not r.dynamic:
            return f"{default}::DOUBLE"
        return (f"CASE WHEN atr14 IS NULL OR atr14 <= 0 OR len(recent) < 10 THEN {default}::DOUBLE "
                f"WHEN below / len(recent) * 100 < {r.dynamic_low} THEN {choice[0]}::DOUBLE "
                f"WHEN below / len(recent) * 100 > {r.dynamic_high} THEN {choice[2]}::DOUBLE ELSE {choice[1]}::DOUBLE END")
    return f"""
{out}_l AS (SELECT *, {last('list(atr14)', n)} AS recent FROM {src}),
{out}_c AS (SELECT *, len(list_filter(recent, lambda v: v < atr14)) AS below FROM {out}_l),
{out} AS (SELECT *, {pick(r.stop_band, r.dynamic_stop)} AS stop_multiple, {pick(r.hang_band, r.dynamic_hang)} AS hang_multiple FROM {out}_c)"""


def half_even(x: str) -> str:
    """Two decimals, ties to the even digit, in integer arithmetic on millionths."""
    k = f"round(({x}) * 1e6::DOUBLE)::BIGINT"
    return f"(CASE WHEN {k} % 10000 = 5000 THEN {k} // 10000 + ({k} // 10000) % 2 ELSE ({k} + 5000) // 10000 END / 100.0::DOUBLE)"


def limit_sql(r: Rules) -> str:
    return half_even(f"greatest(least(close * (1 - {r.limit_discount}::DOUBLE), yellow_line), close - 2.0 * atr14)")


FILL_REASON = """CASE WHEN lim <= 0 OR open <= 0 OR low <= 0 THEN 'invalid_data'
 WHEN volume_ma > 0 AND volume / volume_ma < 0.5 THEN 'not_filled_low_volume' WHEN open <= lim THEN 'gap_down_fill'
 WHEN low < lim - 0.01::DOUBLE THEN 'intraday_fill' WHEN low <= lim THEN 'not_filled_no_penetration' ELSE 'not_filled_gap_up' END"""
FILL_PRICE = f"""CASE WHEN why = 'gap_down_fill' THEN {half_even('greatest(least(open * (1 + 0.001::DOUBLE), lim), open)')}
 WHEN why = 'intraday_fill' THEN {half_even('lim')} ELSE 0.0::DOUBLE END"""


def parity(price: str, r: Rules) -> str:
    wanted = f"({r.cash * r.risk_share}::DOUBLE / CASE WHEN stop_multiple * prev_atr > 0 THEN stop_multiple * prev_atr END)"
    low, high = f"({r.cash * r.min_share}::DOUBLE / {price})", f"({r.cash * r.max_share}::DOUBLE / {price})"
    # A missing size stays missing: the least/greatest pair must not fall back to the bounds.
    inner = f"CASE WHEN {wanted} IS NOT NULL AND {price} IS NOT NULL THEN {lots(f'least(greatest({wanted}, {low}), {high})')} ELSE 0 END"
    return f"coalesce(greatest({inner}, 0), 0)"


CLIMAX = {
    60: lambda r: f"""coalesce(volume > volume_ma * {r.climax_volume}
        AND NOT coalesce(mean_return_before10 = 0 OR abs(coalesce(daily_return, 0)) >= abs(mean_return_before10) * {r.climax_return}, false)
        AND (upper_shadow > body * 1.5 OR (close < open AND body / (amplitude + 1e-8::DOUBLE) > 0.6)), false)""",
    61: lambda r: f"""coalesce(volume / (volume_ma + 1e-8::DOUBLE) > {r.climax_volume} AND body / (close + 1e-8::DOUBLE) < {r.climax_body}
        AND upper_shadow > body * {r.climax_shadow}, false)""",
}


def rows_sql(r: Rules, version: int, signal: str, gate: str) -> str:
    """Per-bar decisions as CTE ``bar``; ``gate`` is the allow expression over CTE ``gated``."""
    if not r.limit_order:
        fill = "open"
    elif version >= 64:
        fill = "CASE WHEN open <= lim THEN open WHEN low <= lim THEN lim END"
    else:
        fill = f"CASE WHEN why IN ('gap_down_fill', 'intraday_fill') THEN {FILL_PRICE} END"
    size = parity("fill", r) if r.parity else lots(f"{r.cash * r.fixed_share}::DOUBLE / fill")
    if version >= 64 and r.score_size:
        size = f"floor({size} * ({case_map('entry_score', r.score_size, 1.0)})::DOUBLE)"
    sig_allow = "allow" if version >= 61 else "true"
    return f"""{stops(r, 'sig', 'st')},
gated AS ({gate}),
lim0 AS (SELECT *, {limit_sql(r)} AS lp FROM gated),
lim1 AS (SELECT *, {over('lag(lp)')} AS lim, {over('lag(score)')} AS entry_score, {over('lag(factor_code)')} AS entry_code FROM lim0),
lim2 AS (SELECT *, {FILL_REASON} AS why FROM lim1),
fills AS (SELECT *, {fill} AS fill FROM lim2),
sized AS (SELECT *, ({size})::BIGINT AS size FROM fills),
bar AS MATERIALIZED (SELECT sym, d, rn, high, close, fill, size, prev_atr AS atr, stop_multiple AS stop, hang_multiple AS hang,
   coalesce(entry_score, 0) AS score, entry_code AS code,
   coalesce(open <= prev_close + {r.gap_limit} * prev_atr AND open >= prev_yellow AND open > 0 AND allow AND size > 0, false) AS can_enter,
   {signal} AND {sig_allow} AS is_sig, {CLIMAX[60 if version == 60 else 61](r)} AS climax,
   coalesce(white_line < yellow_line AND prev_white >= prev_yellow, false) AS cross_down FROM sized)"""


def reason_sql(r: Rules, version: int) -> str:
    stop = "pnl <= -(p_stop * p_atr / p_price)"
    climax = f"climax AND peak >= {r.climax_peak}"
    if version == 60:
        return f"""CASE WHEN {stop} THEN 'ATR_HARD_STOP'
  WHEN peak >= {r.trail_trigger} AND peak - pnl >= {r.trail_drop} THEN 'TRAILING_TAKE'
  WHEN peak >= {r.keep_low} AND peak < {r.keep_high} AND pnl <= {r.keep_level} THEN 'BREAKEVEN_STOP'
  WHEN {climax} THEN 'BUY_CLIMAX' WHEN hold >= {r.idle_days} AND pnl <= {r.idle_return} THEN 'TIME_STOP'
  WHEN cross_down THEN 'DEATH_CROSS' WHEN hold >= {r.max_days} THEN 'MAX_HOLD' END"""
    even = f"WHEN peak >= {r.break_even_trigger} AND pnl <= {r.break_even_level} THEN 'BREAKEVEN_STOP' " if version >= 64 and r.break_even else ""
    first = (f"CASE {even}WHEN {stop} THEN 'ATR_HARD_STOP' WHEN close < line AND hold >= {r.hang_min_days} THEN 'CHANDELIER_EXIT' "
             f"WHEN {climax} THEN 'BUY_CLIMAX' END")
    days = case_map("p_score", r.idle_days_by_score, r.idle_days) if version >= 64 else str(r.idle_days)
    if version >= 63:
        days = f"CASE WHEN pnl * 100 >= {r.extend_from} THEN {r.extend_days} ELSE {days} END"
    timed = f"CASE WHEN (hold >= ({days}) AND pnl < {r.idle_return}) OR hold >= {r.max_days} OR cross_down THEN 'TIME_STOP' END"
    if version < 64:
        return f"coalesce({first}, {timed})"
    late = f"coalesce({timed}, {first})"
    if r.tiers:
        lo, mid, hi = r.tier_drop
        late = (f"CASE WHEN peak >= {r.tier_from} THEN CASE WHEN peak - pnl >= CASE WHEN peak >= 0.20 THEN {hi} WHEN peak >= 0.10 "
                f"THEN {mid} ELSE {lo} END THEN 'PROFIT_TIER' ELSE {first} END ELSE {late} END")
    if r.early:
        late = f"CASE WHEN hold >= {r.early_days} AND pnl < {r.early_return} THEN 'EARLY_EXIT' ELSE {late} END"
    return f"coalesce({first}, {late})" if r.strict_order else late


def fold_sql(r: Rules, version: int) -> str:
    """The position walked bar by bar; closed trades are the rows with a reason."""
    return f"""
walk AS (
 SELECT sym, rn, is_sig AS pending, false AS held, NULL::DATE AS entry_d, NULL::DOUBLE AS p_price,
   NULL::DOUBLE AS p_atr, NULL::BIGINT AS p_shares, NULL::DOUBLE AS p_stop, NULL::DOUBLE AS p_hang, NULL::INT AS p_score,
   NULL::VARCHAR AS p_code, 0 AS hold, 0.0::DOUBLE AS peak, 0.0::DOUBLE AS top, 0.0::DOUBLE AS line, NULL::VARCHAR AS reason,
   NULL::DOUBLE AS pnl, NULL::DATE AS exit_d, NULL::DOUBLE AS exit_price FROM bar WHERE rn = 1
 UNION ALL
 SELECT sym, rn, (NOT waiting AND NOT was_held AND is_sig) AS pending,
   enters OR (was_held AND why IS NULL),
   CASE WHEN enters THEN d ELSE entry_d END, CASE WHEN enters THEN fill ELSE p_price END,
   CASE WHEN enters THEN atr ELSE p_atr END, CASE WHEN enters THEN size ELSE p_shares END,
   CASE WHEN enters THEN stop ELSE p_stop END, CASE WHEN enters THEN hang ELSE p_hang END,
   CASE WHEN enters THEN score ELSE p_score END, CASE WHEN enters THEN code ELSE p_code END,
   CASE WHEN enters THEN 0 ELSE hold END, CASE WHEN enters THEN 0.0 ELSE peak END, CASE WHEN enters THEN high ELSE top END,
   CASE WHEN enters THEN greatest(0.0, high - hang * atr) ELSE line END, why, pnl,
   CASE WHEN why IS NOT NULL THEN d END, CASE WHEN why IS NOT NULL THEN close END
 FROM (SELECT *, CASE WHEN was_held THEN {reason_sql(r, version)} END AS why FROM (
   SELECT *, greatest(line0, top - p_hang * p_atr) AS line FROM (
     SELECT b.*, w.entry_d, w.p_price, w.p_atr, w.p_shares, w.p_stop, w.p_hang, w.p_score, w.p_code,
       w.pending AS waiting, w.held AS was_held, w.pending AND b.can_enter AS enters,
       CASE WHEN w.held THEN w.hold + 1 ELSE w.hold END AS hold,
       CASE WHEN w.held THEN greatest(w.peak, (b.high - w.p_price) / w.p_price) ELSE w.peak END AS peak,
       CASE WHEN w.held THEN greatest(w.top, b.high) ELSE w.top END AS top, w.line AS line0,
       (b.close - w.p_price) / w.p_price AS pnl
     FROM walk w JOIN bar b ON b.sym = w.sym AND b.rn = w.rn + 1)))),
closed AS (SELECT sym, entry_d AS buy_date, exit_d AS sell_date, p_price AS buy_price, exit_price AS sell_price, p_shares AS shares,
   hold AS hold_days, pnl * 100 AS profit_pct, peak * 100 AS max_profit_pct, reason AS exit_reason, p_code AS factor_details
   FROM walk WHERE reason IS NOT NULL)"""


GATES = {
    None: "SELECT *, true AS allow FROM st",
    "industry_gate": "SELECT st.*, coalesce(a.allow, true) AS allow FROM st LEFT JOIN universe u USING (sym) "
                     "LEFT JOIN allowed a ON a.industry = u.industry AND a.d = st.d",
    "market_gate": "SELECT st.*, coalesce(m.state = 1, true) AS allow FROM st LEFT JOIN daily m ON m.d = st.d",
}
GATES["strength_gate"] = GATES["industry_gate"]


def ledger_ctes(r: Rules, version: int, signal: str, gate) -> list[str]:
    name = gate.__name__ if gate else None
    parts = [base(), UNIVERSE]
    if name == "industry_gate":
        parts += [MOMENTUM(r.industry_days), allow_abs(r.industry_threshold)]
    elif name == "strength_gate":
        parts += [MOMENTUM(r.industry_days), allow_rs(r.industry_top)]
    elif name == "market_gate":
        parts += [MARKET, REGIME_CTE]
    return parts + [tags(r), rows_sql(r, version, signal, GATES[name]), fold_sql(r, version)]


ROUNDED = ("sym, buy_date, sell_date, round(buy_price, 2) AS buy_price, round(sell_price, 2) AS sell_price, shares, hold_days, "
           "round(profit_pct, 6) AS profit_pct, round(max_profit_pct, 6) AS max_profit_pct, exit_reason, factor_details")
BEST_LEDGER = ledger_ctes(BEST, 64, "signal_v64", None)
METRICS = """count(*) AS total, count(*) FILTER (profit_pct > 0) AS wins, count(*) FILTER (profit_pct <= 0) AS losses,
 round(count(*) FILTER (profit_pct > 0) / count(*) * 100, 4) AS win_rate, round(avg(profit_pct), 4) AS avg_profit,
 round(coalesce(avg(profit_pct) FILTER (profit_pct > 0), 0), 4) AS avg_win,
 round(coalesce(abs(avg(profit_pct) FILTER (profit_pct <= 0)), 0.01::DOUBLE), 4) AS avg_loss,
 round(CASE WHEN coalesce(abs(avg(profit_pct) FILTER (profit_pct <= 0)), 0.01::DOUBLE) > 0
   THEN coalesce(avg(profit_pct) FILTER (profit_pct > 0), 0) / coalesce(abs(avg(profit_pct) FILTER (profit_pct <= 0)), 0.01::DOUBLE) ELSE 999 END, 4) AS profit_factor,
 round(avg(hold_days), 4) AS avg_hold, round(avg(max_profit_pct), 4) AS avg_peak, round(coalesce(sum(profit_pct), 0), 4) AS total_profit"""


def nested(r: Rules, columns: str, name: str) -> str:
    """A whole ledger as one CTE, so that two of them fit into one statement."""
    return f"{name} AS ({query(f'SELECT {columns} FROM closed', *ledger_ctes(r, 64, 'signal_v64', None))})"


def oracle_sql() -> dict[str, str]:
    out = {n: query(f"SELECT {ROUNDED} FROM closed", *ledger_ctes(*spec)) for n, spec in LEDGERS.items()}
    q = lambda select, *extra: query(select, *BEST_LEDGER, *extra)
    out["ledger_metrics"] = q(f"""SELECT {METRICS}, coalesce(array_to_string(list_transform(map_entries(histogram(exit_reason)),
      lambda e: e.key || ':' || e.value), '|'), '') AS exits FROM closed""")
    out["ledger_exit_counts"] = q("SELECT string_agg(exit_reason || ':' || n, '|' ORDER BY exit_reason) AS exits FROM (SELECT exit_reason, count(*) AS n FROM closed GROUP BY 1)")
    out["ledger_by_exit"] = q("SELECT exit_reason, count(*) AS trades, round(avg(profit_pct), 4) AS avg_profit FROM closed GROUP BY 1")
    out["ledger_by_symbol"] = q("""SELECT s.sym, s.signals, coalesce(t.trades, 0) AS trades, t.avg_profit, t.win_rate
      FROM (SELECT sym, count(*) FILTER (signal_v64) AS signals FROM sig GROUP BY 1) s LEFT JOIN
      (SELECT sym, count(*) AS trades, round(avg(profit_pct), 4) AS avg_profit,
         round(count(*) FILTER (profit_pct > 0) / count(*) * 100, 4) AS win_rate FROM closed GROUP BY 1) t USING (sym)""")
    out["ledger_by_score"] = q("""SELECT score, sum(n)::BIGINT AS trades, round(sum(w) / sum(n) * 100, 4) AS win_rate,
      round(sum(p) / sum(n), 4) AS avg_profit, string_agg(CASE WHEN rk <= 5 THEN code || ':' || n END, '|' ORDER BY rk) AS patterns
      FROM (SELECT *, row_number() OVER (PARTITION BY score ORDER BY n DESC, code) AS rk FROM (
        SELECT factor_details AS code, count(*) AS n, count(*) FILTER (profit_pct > 0) AS w, sum(profit_pct) AS p,
          list_sum(list_transform(regexp_extract_all(factor_details, '[0-9]'), lambda x: x::INT))::INT AS score
        FROM closed GROUP BY factor_details)) GROUP BY score""")
    out["ledger_breakdown_rollup"] = q("""SELECT year(buy_date)::INT AS year, exit_reason,
      grouping(year(buy_date), exit_reason)::INT AS level, count(*) AS trades,
      round(count(*) FILTER (profit_pct > 0) / count(*) * 100, 4) AS win_rate, round(sum(profit_pct), 4) AS total_profit
      FROM closed GROUP BY ROLLUP (year(buy_date), exit_reason)""")
    out["ledger_by_regime"] = q(f"SELECT coalesce(m.state, -1) AS state, {METRICS} FROM closed LEFT JOIN daily m ON m.d = buy_date GROUP BY 1",
                                MARKET, REGIME_CTE)
    out["ledger_regime_filter"] = q(f"SELECT {ROUNDED} FROM closed LEFT JOIN daily m ON m.d = buy_date WHERE coalesce(m.state = 1, true)",
                                    MARKET, REGIME_CTE)
    out["benchmark_excess"] = q("""SELECT round(s, 4) AS strategy_pct, round((b / a - 1) * 100, 4) AS index_pct,
      round(s - (b / a - 1) * 100, 4) AS excess_pct, round(s / ((d1 - d0) / 365.25::DOUBLE), 4) AS strategy_per_year
      FROM (SELECT sum(profit_pct) AS s, min(buy_date) AS d0, max(sell_date) AS d1 FROM closed),
      (SELECT arg_min(close, d) AS a, arg_max(close, d) AS b FROM index_daily)""", INDEX)
    out["t1_entry_candidates"] = query(f"""SELECT sym, d, open, CASE WHEN open > prev_close + {BEST.gap_limit} * prev_atr THEN 'gap_up'
      WHEN open < prev_yellow THEN 'below_line' ELSE 'ok' END AS verdict FROM (SELECT *, {over('lag(signal_v64)')} AS a FROM sig) WHERE a""",
                                       base(), tags(BEST))
    plain = base(rec=False)
    with_limit = f"lims AS (SELECT * FROM (SELECT *, {over(f'lag(lp)')} AS lim FROM (SELECT *, {limit_sql(V63)} AS lp FROM ind)) WHERE lim IS NOT NULL)"
    out["limit_price"] = query(f"SELECT sym, d, {limit_sql(V63)} AS limit_price FROM ind", plain)
    out["limit_fill"] = query(f"SELECT sym, d, why IN ('gap_down_fill', 'intraday_fill') AS filled, {FILL_PRICE} AS fill_price, "
                              f"why AS fill_reason FROM (SELECT *, {FILL_REASON} AS why FROM lims)", plain, with_limit)
    out["limit_fill_simple"] = query("SELECT sym, d, CASE WHEN open <= lim THEN open WHEN low <= lim THEN lim END AS fill_price FROM lims",
                                     plain, with_limit)
    out["slippage_price"] = query(f"SELECT sym, d, {half_even('open * (1 + 0.001::DOUBLE)')} AS buy_price, "
                                  f"{half_even('open * (1 - 0.001::DOUBLE)')} AS sell_price FROM bars", plain)
    out["shares_fixed"] = query(f"SELECT sym, d, {lots(f'{V60.cash * V60.fixed_share}::DOUBLE / open')}::BIGINT AS shares FROM bars", plain)
    out["shares_vol_parity"] = query(f"SELECT sym, d, ({parity('open', V63)})::BIGINT AS shares FROM st WHERE prev_atr IS NOT NULL",
                                     plain, stops(V63, "ind", "st"))
    out["shares_score_scaled"] = query(
        f"SELECT sym, d, entry_score, floor({parity('open', V64)} * ({case_map('entry_score', V64.score_size, 1.0)})::DOUBLE)::BIGINT AS shares "
        f"FROM (SELECT *, {over('lag(score)')} AS entry_score FROM st) WHERE prev_atr IS NOT NULL", base(), tags(V64), stops(V64, "sig", "st"))
    out["tag_buy_climax_v60"] = query(f"SELECT sym, d, {CLIMAX[60](V60)} AS climax FROM ind", plain)
    out["tag_buy_climax_v61"] = query(f"SELECT sym, d, {CLIMAX[61](V61)} AS climax FROM ind", plain)
    out["position_path"] = q("""SELECT w.sym, w.entry_d AS buy_date, b.d, round(w.peak * 100, 6) AS peak_pct, round(w.line, 6) AS trailing_line
      FROM walk w JOIN bar b USING (sym, rn) JOIN closed t ON t.sym = w.sym AND t.buy_date = w.entry_d
      WHERE b.d BETWEEN t.buy_date AND t.sell_date AND (w.held OR w.reason IS NOT NULL)""")
    out["ledger_filtered_out"] = query(f"SELECT {ROUNDED} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.sym = a.sym AND b.buy_date = a.buy_date)",
                                       nested(V64, "*", "a"), nested(FLOW, "sym, buy_date", "b"))
    out["ledger_ab_delta"] = query("""SELECT na AS base_trades, nb AS variant_trades, nb - na AS trade_delta,
      round(wb / nb * 100 - wa / na * 100, 4) AS win_rate_delta, round(pb - pa, 4) AS profit_delta FROM
      (SELECT count(*) AS na, count(*) FILTER (profit_pct > 0) AS wa, sum(profit_pct) AS pa FROM a),
      (SELECT count(*) AS nb, count(*) FILTER (profit_pct > 0) AS wb, sum(profit_pct) AS pb FROM b)""",
                                   nested(V64, "profit_pct", "a"), nested(FLOW, "profit_pct", "b"))
    s63 = query("SELECT sym, d FROM sig WHERE signal_v63", base(), tags(V63))
    s64 = query("SELECT sym, d FROM sig WHERE signal_v64", base(), tags(V64))
    out["compare_signals_full_outer"] = (
        f"SELECT coalesce(a.sym, b.sym) AS sym, coalesce(a.d, b.d) AS d, a.sym IS NOT NULL AS in_v63, b.sym IS NOT NULL AS in_v64 "
        f"FROM ({s63}) a FULL OUTER JOIN ({s64}) b ON a.sym = b.sym AND a.d = b.d")
    return out
