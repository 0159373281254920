from __future__ import annotations

from oracle.ledgers import GATES
from oracle.market import MOMENTUM, REGIME_CTE, allow_abs, grid_ctes
from oracle.prelude import BARS, BARS_RAW, INDEX, MARKET, UNIVERSE, base, query, tags
from sparkbars.params import BEST, FINE_GRID

PRICES = "round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 2) AS volume"
OLD = "old AS (SELECT * FROM bars WHERE d < DATE '2000-01-01' + ((sym % 5) * 14)::INT)"
NEW = """new AS (SELECT sym, d, open * f AS open, high * f AS high, low * f AS low, close * f AS close, volume FROM
  (SELECT *, CASE WHEN sym % 6 = 0 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS f FROM bars WHERE d >= DATE '2000-01-01' - 21))"""
DIRTY = """
num AS (SELECT sym, d, sqrt(sqrt(open)) * 10 AS open, sqrt(sqrt(high)) * 10 AS high, sqrt(sqrt(low)) * 10 AS low,
  sqrt(sqrt(close)) * 10 AS close, volume, row_number() OVER (PARTITION BY sym ORDER BY d) AS n FROM bars),
dirty AS (SELECT sym, d, CASE WHEN n % 19 = 11 THEN 0 ELSE open END AS open, high, low,
  CASE WHEN n % 17 = 9 THEN NULL WHEN (sym % 2 = 0 AND n % 120 = 65) OR (sym % 2 = 1 AND n % 40 = 20) THEN close * 2 ELSE close END AS close,
  CASE WHEN n % 13 = 5 THEN 0 ELSE volume END AS volume FROM num)"""
GOOD = "volume > 0 AND open > 0 AND high > 0 AND low > 0 AND close > 0"


def jumps(src: str, out: str) -> str:
    return f"""
{out}_a AS (SELECT *, coalesce(abs(close / lag(close) OVER (PARTITION BY sym ORDER BY d) - 1) > 0.5, false) AS jump FROM {src} WHERE {GOOD}),
{out}_b AS (SELECT *, count(*) FILTER (jump) OVER (PARTITION BY sym) AS jumps FROM {out}_a),
{out} AS (SELECT sym, d, open, high, low, close, volume FROM {out}_b WHERE NOT jump OR jumps > 3)"""


LAST_NEW = "last_new AS (SELECT sym, arg_max(close, d) AS c FROM new GROUP BY 1)"
DAY = """oneday AS (SELECT sym, DATE '2001-12-03' AS d, c * 2 AS open, c * 2.2::DOUBLE AS high, c * 1.9::DOUBLE AS low, c * 2.1::DOUBLE AS close,
  (sym % 50 + 1)::DOUBLE AS volume, CASE WHEN sym % 9 = 4 THEN 0 ELSE c * 2 END AS pre_close FROM last_new)"""
CAL = """
cal AS (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS d FROM orders),
calendar AS (SELECT d, CASE WHEN day(d) = 1 THEN false WHEN isodow(d) = 6 AND day(d) BETWEEN 8 AND 14 THEN true ELSE isodow(d) < 6 END AS is_open FROM cal)"""
LISTING = """
listing AS (SELECT sym, substr('60389', (sym % 5 + 1)::INT, 1) || (sym + 10000) AS code,
  CASE sym % 11 WHEN 0 THEN 'ST' || name WHEN 1 THEN '*ST' || name WHEN 2 THEN 'N' || name WHEN 3 THEN name || '退' ELSE name END AS name,
  industry, DATE '2016-01-01' + (sym * 37 % 2000)::INT AS list_date, balance / 500 AS last, (sym % 4)::DOUBLE AS volume, balance FROM universe),
coded AS (SELECT *, CASE WHEN code LIKE '6%' THEN code || '.SH' WHEN code LIKE '0%' OR code LIKE '3%' THEN code || '.SZ' END AS symbol FROM listing),
tradable AS (SELECT * FROM coded WHERE NOT (name LIKE 'ST%' OR name LIKE '*ST%' OR name LIKE 'N%') AND name NOT LIKE '%退%' AND volume > 0
  AND symbol IS NOT NULL AND last >= 3)"""


def oracle_sql() -> dict[str, str]:
    o = {}
    b = lambda select, *extra: query(select, BARS, *extra)
    cols = f"sym, d, {PRICES}"
    o["scan_symbol_bars"] = b(f"SELECT {cols} FROM bars WHERE sym IN (SELECT sym FROM bars GROUP BY 1 HAVING count(*) >= 10)")
    o["bars_min_history"] = b(f"SELECT {cols} FROM bars WHERE sym IN (SELECT sym FROM bars GROUP BY 1 HAVING count(*) >= 290)")
    o["scan_csv_bars"] = b(f"SELECT {cols} FROM bars")
    o["sink_csv_bars"] = query("SELECT sym, count(*) AS rows, round(sum(volume), 2) AS volume FROM bars_raw GROUP BY 1", BARS_RAW)
    o["replace_partition"] = b(f"""SELECT {cols} FROM (SELECT * REPLACE (CASE WHEN sym % 10 = 4 THEN sym + 1000000 ELSE sym END AS sym,
      CASE WHEN sym % 10 IN (3, 4) THEN close + 1 ELSE close END AS close) FROM bars)""")
    o["scan_one_symbol"] = b(f"SELECT {cols} FROM bars WHERE sym = (SELECT max(sym) FROM bars) AND (SELECT count(*) FROM bars WHERE sym = (SELECT max(sym) FROM bars)) >= 10")
    raw = """raw AS (SELECT * EXCLUDE (rn) REPLACE (CASE WHEN sym % 11 = 5 THEN 0 ELSE volume END AS volume) FROM
      (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d) AS rn FROM bars) WHERE sym % 7 <> 0 OR rn <= 5)"""
    o["migrate_table"] = b(f"SELECT {cols} FROM kept WHERE sym IN (SELECT sym FROM raw GROUP BY 1 HAVING count(*) >= 10)", raw, jumps("raw", "kept"))
    lines = """lines AS (SELECT *, (sym % 7 = 3 AND n = 2) OR (sym % 7 = 5 AND n % 9 = 4) AS bad FROM
      (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d) AS n FROM bars) WHERE sym % 11 <> 6)"""
    o["scan_csv_files"] = b(f"SELECT {cols} FROM lines WHERE NOT bad", lines)
    o["csv_file_report"] = b("""SELECT sym, coalesce(r, 0) AS rows, coalesce(x, 0) AS broken, first_broken,
      CASE WHEN x > 0 THEN 'broken' WHEN r > 0 THEN 'complete' ELSE 'empty' END AS status FROM (SELECT DISTINCT sym FROM bars) LEFT JOIN
      (SELECT sym, count(*) FILTER (NOT bad) AS r, count(*) FILTER (bad) AS x, (min(d) FILTER (bad))::VARCHAR AS first_broken FROM lines GROUP BY 1) USING (sym)""", lines)
    o["merge_into_table"] = b(f"""SELECT {cols} FROM (SELECT * FROM new WHERE sym % 10 = 7 UNION ALL
      SELECT * FROM old WHERE (sym, d) NOT IN (SELECT sym, d FROM new WHERE sym % 10 = 7))""", OLD, NEW)
    o["append_to_table"] = b(f"""SELECT {cols} FROM (SELECT * FROM old UNION ALL SELECT n.* FROM new n LEFT JOIN
      (SELECT sym, max(d) AS latest FROM old GROUP BY 1) USING (sym) WHERE sym % 10 = 7 AND (latest IS NULL OR d > latest))""", OLD, NEW)
    o["delete_symbol"] = b(f"SELECT {cols} FROM bars WHERE sym % 10 <> 3")
    o["migrate_report"] = b("""SELECT status, count(*) AS symbols, coalesce(sum(kept), 0)::BIGINT AS rows_kept FROM
      (SELECT f.sym, CASE WHEN f.n < 10 THEN 'skipped' WHEN coalesce(k.n, 0) = 0 THEN 'failed' ELSE 'migrated' END AS status, k.n AS kept
       FROM (SELECT sym, count(*) AS n FROM raw GROUP BY 1) f LEFT JOIN (SELECT sym, count(*) AS n FROM kept GROUP BY 1) k USING (sym)) GROUP BY 1""",
                            """raw AS (SELECT * REPLACE (CASE WHEN sym % 11 = 5 THEN 0 ELSE volume END AS volume) FROM
                               (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d) AS rn FROM bars) WHERE sym % 7 <> 0 OR rn <= 5)""", jumps("raw", "kept"))
    o["cache_stats"] = b("SELECT count(DISTINCT sym) AS symbols, count(*) AS rows, min(d) AS first, max(d) AS last FROM bars")
    o["latest_date_per_symbol"] = b("SELECT sym, max(d) AS latest FROM old GROUP BY 1", OLD)
    o["latest_close_per_symbol"] = b("SELECT sym, d, round(close, 4) AS close FROM bars WHERE (sym, d) IN (SELECT sym, max(d) FROM bars GROUP BY sym)")
    o["stale_symbols"] = b("SELECT sym, max(d) AS latest FROM old GROUP BY 1 HAVING max(d) < DATE '2000-02-01'", OLD)
    o["backfill_dates"] = b("""SELECT d FROM (SELECT unnest(generate_series(f + 1, DATE '2000-03-31', INTERVAL 1 DAY))::DATE AS d FROM
      (SELECT min(latest) AS f FROM (SELECT max(d) AS latest FROM old GROUP BY sym))) WHERE isodow(d) < 6""", OLD)
    o["incremental_merge"] = b(f"SELECT {cols} FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE (sym, d) NOT IN (SELECT sym, d FROM new))", OLD, NEW)
    o["append_newer_only"] = b(f"SELECT {cols} FROM new LEFT JOIN (SELECT sym, max(d) AS latest FROM old GROUP BY 1) USING (sym) WHERE latest IS NULL OR d > latest", OLD, NEW)
    o["exrights_check"] = b("""SELECT sym, l.d, coalesce(NOT (abs(l.close - n.close) / nullif(l.close, 0) > 0.01), true) AS consistent
      FROM (SELECT sym, max(d) AS d, arg_max(close, d) AS close FROM old GROUP BY 1) l LEFT JOIN new n USING (sym, d)""", OLD, NEW)
    o["history_gaps"] = b("SELECT sym, DATE '1995-01-02' AS fill_from, min(d) - 1 AS fill_to FROM bars GROUP BY 1 HAVING min(d) > DATE '1995-01-07'")
    o["merge_day_adjusted"] = b("""SELECT sym, d, round(open * r, 4) AS open, round(high * r, 4) AS high, round(low * r, 4) AS low, round(close * r, 4) AS close,
      round(volume, 2) AS volume FROM (SELECT o.*, coalesce(l.c / nullif(pre_close, 0), 1) AS r, l.c AS adj FROM oneday o LEFT JOIN
        (SELECT sym, arg_max(close, d) AS c, max(d) AS latest FROM old WHERE sym % 8 <> 2 GROUP BY 1) l USING (sym) WHERE latest IS NULL OR latest < d)
      WHERE adj IS NULL OR pre_close > 0""", OLD, NEW, LAST_NEW, DAY)
    o["forward_adjust"] = b("""SELECT sym, d, round(open * r, 4) AS open, round(high * r, 4) AS high, round(low * r, 4) AS low,
      round(close * r, 4) AS close, round(volume, 2) AS volume FROM
      (SELECT b.*, coalesce((SELECT arg_max(f, fd) FROM fac WHERE fs = b.sym AND fd <= b.d) / (SELECT arg_max(f, fd) FROM fac WHERE fs = b.sym), 1) AS r FROM bars b)""",
                            "fac AS (SELECT sym AS fs, d + 2 AS fd, (year(d) - 1990 + sym % 3)::DOUBLE AS f FROM bars WHERE sym % 5 <> 4 AND day(d) % 4 = 1)")
    o["splice_realtime_bar"] = b(f"""SELECT {cols} FROM (SELECT * FROM live UNION ALL SELECT * FROM bars WHERE (sym, d) NOT IN (SELECT sym, d FROM live))""",
                                 NEW, LAST_NEW, DAY, """
      ends AS (SELECT sym, max(d) AS ld FROM bars GROUP BY 1),
      quo AS (SELECT o.* REPLACE (unnest([CASE WHEN sym % 2 = 0 THEN ld ELSE o.d END, DATE '2001-12-24']) AS d) FROM oneday o JOIN ends USING (sym)),
      refs AS (SELECT q.sym, q.d AS qd, arg_max(b.close, b.d) AS ref FROM quo q JOIN bars b ON b.sym = q.sym AND b.d < q.d GROUP BY 1, 2),
      rat AS (SELECT q.*, CASE WHEN pre_close > 0 AND ref > 0 THEN ref / pre_close ELSE 1 END AS r FROM quo q LEFT JOIN refs ON refs.sym = q.sym AND qd = q.d),
      live AS (SELECT sym, d, open * r AS open, high * r AS high, low * r AS low, close * r AS close, volume FROM rat)""")
    o["missing_trade_dates"] = query("SELECT d FROM calendar WHERE is_open AND d NOT IN (SELECT d FROM market_daily WHERE day(d) <> 15)", CAL, MARKET)
    o["amv_coalesce"] = query("SELECT d, CASE WHEN day(d) % 2 = 0 THEN amv ELSE amv * 2 END AS amv FROM market_daily WHERE day(d) % 2 = 0 OR day(d) % 3 = 0", MARKET)
    o["retention_window"] = query("SELECT d, amv FROM market_daily WHERE d >= (SELECT max(d) FROM market_daily) - 730", MARKET)
    o["trading_calendar"] = query("SELECT * FROM calendar", CAL)
    o["freshness_gate"] = b("""SELECT latest, last_open, open_before, latest >= last_open AS fresh_after_hours, latest >= open_before AS fresh_intraday FROM
      (SELECT max(d) AS latest FROM bars), (SELECT max(d) AS last_open FROM calendar WHERE is_open),
      (SELECT max(d) AS open_before FROM calendar WHERE is_open AND d < (SELECT max(d) FROM calendar WHERE is_open))""", CAL)
    o["snapshot_sufficiency"] = b("SELECT count(*) AS rows, count(DISTINCT sym) AS symbols, count(*) >= 1000 AS enough_rows, count(DISTINCT sym) >= 1000 AS enough_symbols FROM bars")
    o["report_json"] = query("SELECT industry, sym, count(*) AS signals, max(d) AS last FROM sig JOIN universe USING (sym) WHERE signal_v64 GROUP BY 1, 2",
                             base(), tags(BEST), UNIVERSE)
    o["grid_csv"] = query("SELECT smooth, cost, upper, lower, total_days, bull_days, bear_days, transitions FROM scored", *grid_ctes(FINE_GRID, 0.5, 3))
    o["clean_bars"] = b(f"SELECT {cols} FROM dirty WHERE {GOOD}", DIRTY)
    o["clean_jump_rows"] = b(f"SELECT {cols} FROM cleaned", DIRTY, jumps("dirty", "cleaned"))
    fill = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY sym ORDER BY d ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("open", "high", "low", "close", "volume"))
    o["ffill_dropna"] = b(f"SELECT {cols} FROM (SELECT sym, d, {fill} FROM dirty) WHERE close IS NOT NULL", DIRTY)
    o["normalize_columns"] = b(f"SELECT {cols} FROM bars")
    lst = lambda select, *extra: query(select, UNIVERSE, LISTING, *extra)
    o["normalize_codes"] = lst("SELECT sym, code, symbol, lower(split_part(symbol, '.', 2)) || '.' || split_part(symbol, '.', 1) AS vendor, symbol AS back FROM coded")
    o["universe_filter"] = lst("SELECT sym, symbol, name, list_date FROM coded WHERE symbol IS NOT NULL AND NOT (name LIKE 'ST%' OR name LIKE '*ST%' OR name LIKE 'N%') AND list_date < DATE '2020-01-01'")
    o["spot_prefilter"] = lst("SELECT sym, symbol, name FROM tradable")
    o["sample_symbols"] = query("SELECT sym, md5('42:' || sym) AS key FROM universe ORDER BY key LIMIT 20", UNIVERSE)
    o["prefilter_median_industry"] = lst("SELECT sym, industry FROM tradable WHERE industry IN (SELECT industry FROM ch WHERE c >= (SELECT median(c) FROM ch))",
                                         "ch AS (SELECT industry, avg(balance) AS c FROM universe GROUP BY 1)")
    o["universe_literal_semi"] = b("SELECT sym, count(*) AS rows FROM bars WHERE sym IN (SELECT unnest(range(0, 96, 5))) GROUP BY 1")
    sig = [base(), tags(BEST)]
    o["latest_signals"] = query("SELECT sym, d, round(close, 4) AS close FROM sig WHERE signal_v64 AND (sym, d) IN (SELECT sym, max(d) FROM sig GROUP BY 1)", *sig)
    o["universe_semi_prefilter"] = lst("SELECT sym, u.name FROM universe u WHERE sym IN (SELECT sym FROM tradable)")
    o["resume_anti"] = b("SELECT sym, name FROM universe WHERE sym NOT IN (SELECT sym FROM bars WHERE d >= (SELECT max(d) - 7 FROM bars))", UNIVERSE)
    o["filter_allowed_dates"] = query("SELECT sym, d FROM sig WHERE signal_v64 AND d IN (SELECT d FROM daily WHERE state = 1)", *sig, MARKET, REGIME_CTE)
    st = "st AS (SELECT sym, d FROM sig WHERE signal_v64)"
    o["filter_industry_allow"] = query(f"SELECT sym, d FROM ({GATES['industry_gate']}) WHERE allow", *sig, UNIVERSE, MOMENTUM(BEST.industry_days),
                                       allow_abs(BEST.industry_threshold), st)
    o["gate_market_regime"] = query(f"SELECT sym, d, allow FROM ({GATES['market_gate']})", *sig, MARKET, REGIME_CTE, st)
    o["dates_intersect"] = query("SELECT d FROM market_daily INTERSECT SELECT d FROM index_daily", MARKET, INDEX)
    o["distinct_codes"] = "SELECT l_suppkey AS sym FROM lineitem UNION SELECT s_suppkey FROM supplier"
    o["scan_counters"] = query("""SELECT CASE WHEN n IS NULL THEN 'cache_miss' WHEN n < 290 THEN 'too_short' WHEN hit THEN 'signal' ELSE 'processed' END AS status,
      count(*) AS symbols FROM universe LEFT JOIN (SELECT sym, arg_max(signal_v64, d) AS hit, count(*) AS n FROM sig GROUP BY 1) USING (sym) GROUP BY 1""", *sig, UNIVERSE)
    return o
