from __future__ import annotations

from oracle.prelude import query

TICKS = """
ticks AS (SELECT event_id, ts, user_id, event_type AS sym, value AS price, json_extract_string(props, '$.k')::DOUBLE AS volume FROM events)"""
HOURS = """
hours AS (SELECT sym, date_trunc('hour', ts) AS start, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
   last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    o = {}
    o["stream_ohlcv_bars"] = query("SELECT * FROM hours", TICKS, HOURS)
    o["stream_upsert_bars"] = query("SELECT * FROM hours UNION ALL SELECT DISTINCT sym, TIMESTAMP '1990-01-01', 0.5, 0.5, 0.5, 0.5, 0.5 FROM ticks", TICKS, HOURS)
    o["stream_late_rows"] = query("""SELECT count(*) FILTER (newer OR ts >= mark) AS kept, count(*) FILTER (NOT newer AND ts < mark) AS late FROM
      (SELECT ts, event_id > m AS newer, max(ts) FILTER (event_id > m) OVER () - INTERVAL 10 MINUTE AS mark
       FROM ticks, (SELECT (min(event_id) + max(event_id)) / 2.0 AS m FROM ticks))""", TICKS)
    o["stream_sliding_volume"] = query("""SELECT sym, start, sum(volume) AS volume, count(*) AS ticks FROM
      (SELECT *, date_trunc('hour', ts) - INTERVAL 1 HOUR * unnest(range(0, 6)) AS start FROM ticks) GROUP BY 1, 2""", TICKS)
    o["stream_sessions"] = query("""SELECT user_id, min(ts) AS start, count(*) AS events, sum(volume) AS volume FROM
      (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM
        (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM ticks))
      GROUP BY user_id, n""", TICKS)
    o["stream_quote_splice"] = query("""SELECT event_id, sym AS key, round(price * coalesce(CASE WHEN raw > 0 AND adjusted > 0 THEN adjusted / raw END, 1), 6) AS price FROM
      (SELECT event_id, sym, price, arg_max(close, known) AS adjusted, arg_max(raw, known) AS raw FROM
        (SELECT t.event_id, t.sym, t.price, c.close, c.known, (hour(c.start) % 7)::DOUBLE AS raw FROM ticks t LEFT JOIN
          (SELECT *, start + INTERVAL 1 HOUR AS known FROM hours) c ON c.sym = t.sym AND c.known <= t.ts AND c.known > t.ts - INTERVAL 6 HOUR)
       GROUP BY 1, 2, 3)""", TICKS, HOURS)
    o["stream_regime_latch"] = query("""SELECT sym, start, coalesce(last_value(CASE WHEN close >= 20 THEN 1 WHEN close <= 5 THEN 0 END IGNORE NULLS)
      OVER (PARTITION BY sym ORDER BY start ROWS UNBOUNDED PRECEDING), 0) AS state FROM hours""", TICKS, HOURS)
    o["stream_dedup"] = query("SELECT event_id, sym, price FROM ticks", TICKS)
    o["stream_publish"] = query("""SELECT push_date, mode, arg_min(event_id, ts) AS event_id FROM
      (SELECT ts::DATE AS push_date, CASE WHEN sym IN ('click', 'view') THEN 'intraday' ELSE 'after_hours' END AS mode, ts, event_id FROM ticks WHERE sym <> 'error')
      GROUP BY 1, 2""", TICKS)
    return o
