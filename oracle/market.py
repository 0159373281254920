from __future__ import annotations

from oracle.prelude import BARS, INDEX, MARKET, UNIVERSE, base, query, tags
from sparkbars.params import BEST, FINE_GRID, GRID, REGIME, V62, V63


def mean(col: str, n: int, part: str = "") -> str:
    w = f"({part} ORDER BY d ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({col}) OVER {w} >= {n} THEN avg({col}) OVER {w} END"


def latch(on: str, off: str, part: str = "") -> str:
    return f"coalesce(last_value(CASE WHEN {on} THEN 1 WHEN {off} THEN 0 END IGNORE NULLS) OVER ({part} ORDER BY d ROWS UNBOUNDED PRECEDING), 0)"


UP, LOW = REGIME["upper"], REGIME["lower"]
REGIME_CTE = f"""
sm AS (SELECT *, {mean('amv', REGIME['smooth'])} AS smoothed FROM market_daily),
cm AS (SELECT *, {mean('smoothed', REGIME['cost'])} AS cost_ma FROM sm),
xs AS (SELECT *, (smoothed - cost_ma) / cost_ma * 100 AS x FROM cm),
daily AS (SELECT *, {latch(f'x >= {UP}', f'x <= {LOW}')} AS state FROM xs)"""
WEEK_CTE = f"""
wk AS (SELECT d + ((5 - isodow(d) + 7) % 7)::INT AS week, arg_max(x, d) AS x FROM daily WHERE x IS NOT NULL GROUP BY 1),
wn AS (SELECT *, row_number() OVER (ORDER BY week) AS n FROM wk),
we AS (SELECT n, x AS e FROM wn WHERE n = 1 UNION ALL
       SELECT wn.n, (2 * wn.x + {REGIME['weekly_span'] - 1} * we.e) / {REGIME['weekly_span'] + 1} FROM we JOIN wn ON wn.n = we.n + 1),
wl AS (SELECT week AS d, x, e, lag(x) OVER (ORDER BY week) AS px FROM wn JOIN we USING (n)),
weeks AS (SELECT d, x, {latch(f'x >= {UP} OR (x > {LOW} AND x > e AND x > px)', f'x <= {LOW}')} AS state FROM wl)"""
ASOF = """
permitted AS (SELECT a.*, coalesce(w.state, 1) AS weekly_state, a.state = 1 AND coalesce(w.state, 1) = 1 AS allowed
              FROM daily a ASOF LEFT JOIN weeks w ON a.d >= w.d)"""


def MOMENTUM(n: int) -> str:
    k = max(n // 2, 5)
    w = f"(PARTITION BY industry ORDER BY d ROWS {n - 1} PRECEDING)"
    return f"""
chg AS (SELECT sym, d, close / lag(close) OVER (PARTITION BY sym ORDER BY d) - 1 AS change FROM bars),
irow AS (SELECT u.industry, c.* FROM chg c JOIN universe u USING (sym) WHERE u.industry <> ''),
iday AS (SELECT industry, d, avg(change) AS change FROM irow WHERE industry IN
         (SELECT industry FROM irow GROUP BY 1 HAVING count(DISTINCT sym) >= 3) GROUP BY 1, 2),
mom AS (SELECT industry, d, CASE WHEN count(change) OVER {w} >= {k} THEN sum(change) OVER {w} END AS momentum FROM iday),
dense AS (SELECT i.industry, c.d, m.momentum FROM (SELECT DISTINCT industry FROM mom) i CROSS JOIN (SELECT DISTINCT d FROM mom) c
          LEFT JOIN mom m ON m.industry = i.industry AND m.d = c.d),
ranked AS (SELECT *, CASE WHEN momentum IS NOT NULL THEN
   (rank() OVER (PARTITION BY d, momentum IS NULL ORDER BY momentum) + (count(*) OVER (PARTITION BY d, momentum) - 1) / 2)
   / count(momentum) OVER (PARTITION BY d) END AS rs_rank,
   momentum - lag(momentum, 5) OVER (PARTITION BY industry ORDER BY d) AS step FROM dense)"""


def allow_abs(threshold: float) -> str:
    return f"allowed AS (SELECT industry, d, coalesce(momentum > {threshold}, false) AS allow FROM dense)"


def allow_rs(top: float) -> str:
    return f"""allowed AS (SELECT industry, d, coalesce(rs_rank >= {1.0 - top}::DOUBLE, false)
      OR coalesce(step > 0 AND rs_rank > 0.5, false) AS allow FROM ranked)"""


RETURNS = """
idx AS (SELECT d, close / lag(close) OVER (ORDER BY d) - 1 AS ret FROM index_daily),
series AS (SELECT m.d, m.amv, i.ret FROM market_daily m LEFT JOIN idx i USING (d))"""
MEASURES = """
 round((exp(lb) - 1) * 100, 4) AS bull_cum_pct, round((exp(lr) - 1) * 100, 4) AS bear_cum_pct,
 round((exp(lb * 252 / bull_days) - 1) * 100, 4) AS bull_annual_pct, round((exp(lr * 252 / bear_days) - 1) * 100, 4) AS bear_annual_pct,
 round((exp(lb * 252 / total_days) - 1) * 100, 4) AS strategy_annual_pct, round((exp(la * 252 / total_days) - 1) * 100, 4) AS bh_annual_pct,
 round((exp(lb * 252 / total_days) - 1) * 100 - (exp(la * 252 / total_days) - 1) * 100, 4) AS excess_annual_pct,
 round(wins / bull_days * 100, 4) AS bull_win_rate, round((exp(dd) - 1) * 100, 4) AS max_drawdown_pct,
 round(bull_days / total_days * 100, 4) AS bull_ratio_pct"""


def evaluation(keys: str, least: int = 4) -> str:
    w = f"(PARTITION BY {keys} ORDER BY d ROWS UNBOUNDED PRECEDING)"
    return f"""
e1 AS (SELECT *, coalesce((state <> lag(state) OVER (PARTITION BY {keys} ORDER BY d))::INT, 0) AS flip, ln(1 + ret) AS g,
         CASE WHEN state = 1 THEN ln(1 + ret) ELSE 0 END AS gl FROM states WHERE ret IS NOT NULL),
e2 AS (SELECT *, sum(gl) OVER {w} AS eq FROM e1),
e3 AS (SELECT *, max(eq) OVER {w} AS pk FROM e2),
e4 AS (SELECT {keys}, count(*) AS total_days, count(*) FILTER (state = 1) AS bull_days, count(*) FILTER (state = 0) AS bear_days,
         sum(flip)::BIGINT AS transitions, sum(gl) AS lb, sum(CASE WHEN state = 0 THEN g ELSE 0 END) AS lr, sum(g) AS la,
         count(*) FILTER (state = 1 AND ret > 0) AS wins, min(eq - pk) AS dd FROM e3 GROUP BY {keys}),
scored AS (SELECT {keys}, total_days, bull_days, bear_days, transitions, {MEASURES} FROM e4
           WHERE total_days >= 100 AND transitions >= {least} AND bull_days >= 20 AND bear_days >= 20)"""


def grid_ctes(settings: dict, share: float, least: int) -> list[str]:
    smooths = ", ".join(f"{mean('amv', n)} AS s{n}" for n in settings["smooth"])
    costs = ", ".join(f"{mean(f's{n}', m)} AS c{n}_{m}" for n in settings["smooth"] for m in settings["cost"])
    union = " UNION ALL ".join(f"SELECT d, ret, {n} AS smooth, {m} AS cost, (s{n} - c{n}_{m}) / c{n}_{m} * 100 AS x FROM g2"
                               for n in settings["smooth"] for m in settings["cost"])
    pairs = ", ".join(f"({u}::DOUBLE, {low}::DOUBLE)" for u in settings["upper"] for low in settings["lower"] if u > abs(low) * share)
    keys = "smooth, cost, upper, lower"
    return [MARKET, INDEX, RETURNS, f"g1 AS (SELECT *, {smooths} FROM series), g2 AS (SELECT *, {costs} FROM g1), g3 AS ({union}), "
            f"lims(upper, lower) AS (VALUES {pairs}), g4 AS (SELECT * FROM g3 CROSS JOIN lims), "
            f"states AS (SELECT *, {latch('x >= upper', 'x <= lower', f'PARTITION BY {keys}')} AS state FROM g4)",
            evaluation(keys, least)]


STATS = f"""
back AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY d DESC) AS k FROM dense),
nowm AS (SELECT industry, max(momentum) FILTER (k = 1) AS m, max(momentum) FILTER (k = 6) AS p, max(k) AS dates FROM back GROUP BY 1),
lastsig AS (SELECT sym, arg_max(signal_v64, d) AS is_signal FROM sig GROUP BY 1),
cnt AS (SELECT industry, count(*) AS stock_count, count(*) FILTER (is_signal) AS signal_count FROM lastsig JOIN universe USING (sym) GROUP BY 1),
flags AS (SELECT *, coalesce(m > {BEST.industry_threshold}, false) AS hot, coalesce(p > {BEST.industry_threshold}, false) AS was, m - p AS step
          FROM nowm LEFT JOIN cnt USING (industry) WHERE dates >= 6),
stats AS (SELECT industry, round(m * 100, 4) AS momentum, round(step * 100, 4) AS momentum_change,
  CASE WHEN NOT was AND hot THEN '轮入' WHEN was AND NOT hot THEN '轮出' WHEN hot AND step > 0.01 THEN '加速' WHEN hot AND step < -0.01 THEN '减速'
    WHEN NOT hot AND step > 0.01 THEN '回暖' WHEN NOT hot AND step < -0.01 THEN '恶化' ELSE '平稳' END AS rotation,
  CASE WHEN m > 0.05 THEN '火热' WHEN m > 0.02 THEN '偏热' WHEN m > 0 THEN '微热' WHEN m > -0.02 THEN '微冷' WHEN m > -0.05 THEN '偏冷' ELSE '冰冷' END AS hot_cold,
  coalesce(signal_count, 0) AS signal_count, coalesce(stock_count, 0) AS stock_count FROM flags)"""


def oracle_sql() -> dict[str, str]:
    o = {}
    bars = BARS
    funds = bars + """, funds AS (SELECT sym, d, close * 1000 AS circ_mv, close * 1500 AS total_mv, volume % 17 + 1 AS turnover_rate_f,
      close * volume AS amount, volume, close FROM bars)"""
    o["market_amv"] = query("SELECT d, round(sum(close * volume), 2) AS amv FROM bars WHERE volume > 0 AND close IS NOT NULL "
                            "AND d BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' GROUP BY 1", bars)
    o["market_amv_turnover"] = query("SELECT d, round(sum(circ_mv * turnover_rate_f / 100), 2) AS amv, count(*) AS stock_count FROM funds GROUP BY 1", funds)
    o["amv_unit_repair"] = query("""SELECT d, round(amv * exp(sum(CASE WHEN q > 10 OR q < 0.1 THEN -ln(q) ELSE 0 END) OVER (ORDER BY d)), 2) AS amv
      FROM (SELECT *, CASE WHEN p > 0 AND amv > 0 THEN amv / p END AS q FROM (SELECT *, lag(amv) OVER (ORDER BY d) AS p FROM
        (SELECT d, amv * CASE WHEN d >= DATE '2000-01-01' THEN 0.1::DOUBLE WHEN d >= DATE '1998-01-01' THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END AS amv
         FROM market_daily)))""", MARKET)
    o["amv_smooth_sma"] = query(f"SELECT d, round({mean('amv', 15)}, 4) AS smoothed FROM market_daily", MARKET)
    o["amv_smooth_hybrid"] = query(f"SELECT d, round(0.6 * ({mean('amv', 5)}) + 0.4 * ({mean('amv', 20)}), 4) AS smoothed FROM market_daily", MARKET)
    numbered = "n AS (SELECT d, amv, row_number() OVER (ORDER BY d) AS k FROM market_daily)"
    ema = lambda name, source, column, n: (
        f"{name} AS (SELECT k, d, {column} AS e FROM {source} WHERE k = 1 UNION ALL SELECT s.k, s.d, (2 * s.{column} + {n - 1} * e.e) / {n + 1} "
        f"FROM {name} e JOIN {source} s ON s.k = e.k + 1)")
    for name, n in (("amv_smooth_ema", 15), ("amv_smooth_ema_slow", 42), ("amv_smooth_ema_one", 1)):
        o[name] = query(f"SELECT d, round(e, {3 if n == 42 else 6}) AS smoothed FROM e1", MARKET, numbered, ema("e1", "n", "amv", n))
    o["regime_x_ema"] = query("SELECT d, round(a.e, 2) AS smoothed, round(b.e, 2) AS cost_ma, round((a.e - b.e) / b.e * 100, 5) AS x FROM e1 a JOIN e2 b USING (k, d)",
                              MARKET, numbered, ema("e1", "n", "amv", 15), ema("e2", "e1", "e", 42))
    o["regime_x"] = query("SELECT d, round(smoothed, 4) AS smoothed, round(cost_ma, 4) AS cost_ma, round(x, 6) AS x FROM xs", MARKET, REGIME_CTE)
    o["amv_source_variants"] = query("""SELECT d, round(sum(coalesce(amount, volume * close)), 2) AS by_amount,
      round(sum(total_mv * turnover_rate_f / 100), 2) AS by_total_value, round(sum(circ_mv * turnover_rate_f / 100), 2) AS by_circulating
      FROM funds GROUP BY 1""", funds)
    o["amv_universe"] = query("SELECT d, round(sum(volume * close), 2) AS amv FROM bars GROUP BY 1", bars)
    o["amv_from_fundamentals"] = query("SELECT d, round(coalesce(sum(CASE WHEN turnover_rate_f > 3 THEN total_mv * turnover_rate_f / 100 END), 0), 2) AS amv "
                                       "FROM funds GROUP BY 1", funds)
    reg, wks = [MARKET, REGIME_CTE], [MARKET, REGIME_CTE, WEEK_CTE]
    o["regime_state_daily"] = query("SELECT d, state, round(x, 6) AS x FROM daily", *reg)
    o["weekly_resample"] = query("SELECT week, round(x, 6) AS x FROM wk", *wks)
    o["regime_state_weekly"] = query("SELECT d AS week, round(x, 6) AS x, state FROM weeks", *wks)
    o["asof_weekly_state"] = query("SELECT d, weekly_state FROM permitted", *wks, ASOF)
    o["regime_allowed"] = query("SELECT d, allowed FROM permitted", *wks, ASOF)
    o["regime_transitions"] = query("SELECT d, p AS from_state, state AS to_state, round(x, 6) AS x FROM "
                                    "(SELECT *, lag(state, 1, 0) OVER (ORDER BY d) AS p FROM daily) WHERE state <> p", *reg)
    o["regime_summary"] = query(f"""SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (state = 1) AS bull, count(*) FILTER (state = 0) AS bear,
      count(*) FILTER (x > {LOW} AND x < {UP}) AS buffer, round(count(*) FILTER (state = 1) / count(*) * 100, 4) AS bull_pct,
      round(count(*) FILTER (x > {LOW} AND x < {UP}) / count(x) * 100, 4) AS buffer_pct, sum((state <> p)::INT)::BIGINT AS transitions,
      round(min(x), 6) AS min_x, round(max(x), 6) AS max_x FROM (SELECT *, lag(state, 1, 0) OVER (ORDER BY d) AS p FROM daily)),
      (SELECT count(*) AS weeks, count(*) FILTER (state = 1) AS weeks_bull FROM weeks)""", *wks)
    o["regime_status"] = query("""SELECT d AS latest_date, state = 1 AS daily_allowed, allowed AS can_open_position, round(x, 4) AS latest_x,
      (SELECT string_agg(strftime(d, '%m-%d') || ':' || CASE WHEN state = 1 THEN '允许' ELSE '禁止' END, '|' ORDER BY d DESC)
         FROM (FROM permitted ORDER BY d DESC LIMIT 5)) AS recent,
      (SELECT max(d) FROM f WHERE state <> p) AS last_date,
      (SELECT CASE WHEN arg_max(state, d) = 1 THEN '允许' ELSE '禁止' END FROM f WHERE state <> p) AS last_state,
      CASE WHEN state = 1 THEN '活跃上升' ELSE '萎缩下降' END AS trend_label FROM permitted ORDER BY d DESC LIMIT 1""",
                               *wks, ASOF, "f AS (SELECT *, lag(state, 1, 0) OVER (ORDER BY d) AS p FROM daily)")
    o["regime_changes"] = query("""SELECT (SELECT arg_max(state, d) = 1 FROM daily) AS can_open_position, coalesce(string_agg(
      strftime(d, '%m-%d') || ':' || CASE WHEN state = 1 THEN '牛市' ELSE '熊市' END, '|' ORDER BY d), '') AS changes
      FROM (SELECT d, state FROM (SELECT *, lag(state) OVER (ORDER BY d) AS p FROM daily) WHERE state <> p ORDER BY d DESC LIMIT 3)""", funds,
                                "market_daily AS (SELECT d, round(sum(circ_mv * turnover_rate_f / 100), 2) AS amv FROM funds GROUP BY 1)", REGIME_CTE)
    o["regime_roc_latch"] = query(f"SELECT d, {latch('r >= 0.0425', 'r <= -0.0125')} = 1 AS allowed FROM "
                                  "(SELECT *, amv / lag(amv) OVER (ORDER BY d) - 1 AS r FROM market_daily)", MARKET)
    o["regime_eval"] = query("SELECT * FROM scored", MARKET, INDEX, REGIME_CTE, RETURNS,
                             "states AS (SELECT 'production' AS setting, d, state, ret FROM daily JOIN series USING (d))", evaluation("setting"))
    o["regime_grid"] = query("SELECT * FROM scored", *grid_ctes(GRID, 1.0, 4))
    o["regime_grid_fine"] = query("SELECT * FROM scored", *grid_ctes(FINE_GRID, 0.5, 3))
    tie = "smooth, cost, upper, lower"
    o["regime_grid_topn"] = query(f"""SELECT {tie}, strategy_annual_pct, excess_annual_pct, bear_annual_pct, by_strategy, by_excess, by_avoid, balanced, is_default
      FROM (SELECT *, CASE WHEN pool THEN (row_number() OVER (PARTITION BY pool ORDER BY excess_annual_pct DESC, {tie}))::INT END AS balanced FROM
       (SELECT *, CASE WHEN bool_or(st) OVER () THEN st ELSE rl END AS pool FROM
        (SELECT *, (row_number() OVER (ORDER BY strategy_annual_pct DESC, {tie}))::INT AS by_strategy,
          (row_number() OVER (ORDER BY excess_annual_pct DESC, {tie}))::INT AS by_excess,
          (row_number() OVER (ORDER BY bear_annual_pct, {tie}))::INT AS by_avoid,
          excess_annual_pct > 3 AND transitions < 30 AND bull_ratio_pct > 40 AND bull_ratio_pct < 80 AS st,
          excess_annual_pct > 1 AND transitions < 40 AND bull_ratio_pct > 30 AND bull_ratio_pct < 85 AS rl,
          smooth = 8 AND cost = 21 AND upper = 4.0 AND lower = -2.3 AS is_default FROM scored)))
      WHERE by_strategy <= 20 OR by_excess <= 20 OR by_avoid <= 10 OR balanced <= 10 OR is_default""", *grid_ctes(GRID, 1.0, 4))
    cells = ", ".join(f"max(excess_annual_pct) FILTER (lower = {v}) AS low_{int(-v * 10)}" for v in FINE_GRID["lower"])
    o["regime_grid_pivot"] = query(f"SELECT upper, {cells} FROM scored GROUP BY 1", *grid_ctes(FINE_GRID, 0.5, 3))

    n = BEST.industry_days
    ind = [bars, UNIVERSE, MOMENTUM(n)]
    o["join_industry"] = query("SELECT industry, count(*) AS bars, round(avg(close), 6) AS avg_close FROM sig JOIN universe USING (sym) "
                               "WHERE no_supply AND industry <> '' GROUP BY 1", base(), tags(BEST), UNIVERSE)
    o["industry_momentum"] = query("SELECT industry, d, round(momentum, 6) AS momentum FROM mom", *ind)
    o["industry_allow_abs"] = query("SELECT * FROM allowed", bars, UNIVERSE, MOMENTUM(V62.industry_days), allow_abs(V62.industry_threshold))
    o["industry_rs_rank"] = query("SELECT industry, d, round(rs_rank, 6) AS rs_rank FROM ranked", *ind)
    o["industry_allow_rs"] = query("SELECT * FROM allowed", *ind, allow_rs(V63.industry_top))
    full = [base(), tags(BEST), UNIVERSE, MOMENTUM(n), STATS]
    o["industry_stats"] = query("SELECT * FROM stats", *full)
    o["industry_topn"] = query("""SELECT industry, momentum, top, bottom, hot, cold, rotated_in, rotated_out, faster FROM (SELECT *,
      (row_number() OVER (ORDER BY momentum DESC NULLS LAST, industry))::INT AS top, (row_number() OVER (ORDER BY momentum NULLS LAST, industry))::INT AS bottom,
      count(*) FILTER (momentum > 0) OVER () AS hot, count(*) FILTER (momentum <= 0) OVER () AS cold,
      count(*) FILTER (rotation = '轮入') OVER () AS rotated_in, count(*) FILTER (rotation = '轮出') OVER () AS rotated_out,
      count(*) FILTER (rotation = '加速') OVER () AS faster FROM stats) WHERE top <= 5 OR bottom <= 3""", *full)
    o["industry_ma_lines"] = query("""SELECT industry, d, round(avg(white_line), 4) AS white, round(avg(yellow_line), 9) AS yellow
      FROM ind JOIN universe USING (sym) WHERE industry IN (SELECT industry FROM ind JOIN universe USING (sym) GROUP BY 1 HAVING count(DISTINCT sym) >= 3)
      GROUP BY 1, 2""", base(), UNIVERSE)
    o["asof_nearest_momentum"] = query("""SELECT s.sym, s.d, s.industry, round((SELECT arg_min(m.momentum, abs(m.d - s.d) * 2 + (m.d > s.d)::INT) FROM mom m
        WHERE m.industry = s.industry AND abs(m.d - s.d) <= 1), 6) AS momentum
      FROM (SELECT sym, (d + (sym % 3 - 1)::INT) AS d, industry FROM sig JOIN universe USING (sym) WHERE signal_v64) s""",
                                       base(), tags(BEST), UNIVERSE, MOMENTUM(n))
    o["crash_guard"] = query("""SELECT d, round(m, 6) AS median_ret5, crash, bool_or(crash) OVER (ORDER BY d ROWS 2 PRECEDING) AS paused FROM
      (SELECT *, coalesce(m < -0.05, false) AS crash FROM (SELECT d, median(r) AS m FROM
        (SELECT d, close / lag(close, 5) OVER (PARTITION BY sym ORDER BY d) - 1 AS r FROM bars) WHERE r IS NOT NULL GROUP BY 1))""", bars)
    return o
