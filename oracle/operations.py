from __future__ import annotations

from oracle.prelude import BARS, UNIVERSE, query

NOW = "DATE '2024-01-31'"
USERS = f"""
users AS (SELECT c_custkey AS user_id, c_name AS nickname, plan, c_custkey % 7 <> 3 AS is_subscribed,
    CASE WHEN plan <> 'free' THEN {NOW} + floor((c_acctbal - 4000) / 100)::INT END AS plan_expire
  FROM (SELECT *, CASE c_mktsegment WHEN 'MACHINERY' THEN 'trial' WHEN 'BUILDING' THEN 'free' WHEN 'AUTOMOBILE' THEN 'monthly'
    WHEN 'FURNITURE' THEN 'yearly' ELSE 'quarterly' END AS plan FROM customer))"""
LOGS = """
logs AS (SELECT event_id AS id, ts AS push_time, CASE WHEN event_type IN ('click', 'view') THEN 'intraday' ELSE 'after_hours' END AS mode,
  json_extract_string(props, '$.k')::INT AS signal_count, (event_type <> 'error')::INT AS success, round(value * 100)::BIGINT AS duration_ms,
  user_id, event_type FROM events)"""
OVERDUE = f"plan IN ('trial', 'monthly', 'quarterly', 'yearly') AND plan_expire IS NOT NULL AND plan_expire < {NOW}"


def oracle_sql() -> dict[str, str]:
    o = {}
    o["ops_report"] = query("""SELECT push_time::DATE AS day, count(*) AS pushes, sum(signal_count)::BIGINT AS signals, sum(success)::BIGINT AS succeeded,
      round(sum(success) / count(*), 4) AS success_rate, round(sum(signal_count) / count(*), 4) AS avg_signals,
      round(sum(duration_ms) / count(*) / 1000.0::DOUBLE, 4) AS avg_duration FROM logs WHERE push_time >= TIMESTAMP '2024-01-24' GROUP BY ROLLUP (1)""", LOGS)
    o["metrics_recent"] = ("SELECT event_id, ts, value FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-28' "
                           "ORDER BY ts DESC, event_id LIMIT 500")
    o["ops_last_push"] = query("SELECT push_time, mode, success FROM logs ORDER BY push_time DESC, id LIMIT 1", LOGS)
    o["subscription_stats"] = query(f"""SELECT plan, coalesce(users, 0) AS users, coalesce(active, 0) AS active FROM
      (VALUES ('trial'), ('free'), ('monthly'), ('quarterly'), ('yearly'), ('expired')) p(plan) LEFT JOIN
      (SELECT CASE WHEN {OVERDUE} THEN 'expired' ELSE plan END AS plan, count(*) AS users,
         count(*) FILTER (is_subscribed AND NOT coalesce({OVERDUE}, false)) AS active FROM users GROUP BY 1) USING (plan)""", USERS)
    o["active_subscribers"] = query(f"""SELECT count(*) FILTER (is_subscribed AND plan IN ('trial', 'monthly', 'quarterly', 'yearly')
      AND (plan_expire IS NULL OR plan_expire > {NOW})) AS active FROM users""", USERS)
    o["subscription_state"] = query(f"""SELECT user_id, plan, a AS is_active, plan NOT IN ('free', 'expired') AND a AS has_signals, left_days AS days_remaining FROM
      (SELECT *, coalesce(plan_expire > {NOW}, true) AND is_subscribed AS a,
         CASE WHEN plan_expire IS NULL THEN NULL ELSE greatest(plan_expire - {NOW}, 0)::INT END AS left_days FROM users)""", USERS)
    o["subscription_expire"] = query(f"SELECT * REPLACE (CASE WHEN {OVERDUE} THEN 'expired' ELSE plan END AS plan) FROM users", USERS)
    o["subscription_expire_events"] = query(f"""SELECT user_id, 'plan_expire' AS event_type, plan AS from_plan, 'expired' AS to_plan,
      0::DECIMAL(10,2) AS amount FROM users WHERE {OVERDUE}""", USERS)
    o["subscription_upgrade"] = query("""SELECT user_id, u.plan AS from_plan, coalesce(np, u.plan) AS to_plan,
      CASE WHEN np IS NULL THEN plan_expire ELSE ts::DATE + CASE np WHEN 'monthly' THEN 30 WHEN 'quarterly' THEN 90 ELSE 365 END END AS plan_expire,
      is_subscribed OR np IS NOT NULL AS is_subscribed FROM users u LEFT JOIN
      (SELECT user_id, ts, CASE json_extract_string(props, '$.k')::INT % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' ELSE 'yearly' END AS np
         FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) USING (user_id)""", USERS)
    o["user_upsert"] = query("""SELECT user_id, coalesce(plan, 'trial') AS plan, coalesce(follow, is_subscribed) AS is_subscribed,
      CASE WHEN plan IS NULL THEN ts::DATE + 7 ELSE plan_expire END AS plan_expire FROM users FULL OUTER JOIN
      (SELECT uid AS user_id, ts, event_type = 'signup' AS follow FROM
        (SELECT *, CASE WHEN event_id % 50 = 0 THEN user_id + 1000000 ELSE user_id END AS uid FROM events WHERE event_type IN ('signup', 'error'))
        QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ts DESC, event_id DESC) = 1) USING (user_id) WHERE plan IS NOT NULL OR follow""", USERS)
    o["push_idempotent"] = query("""SELECT push_time::DATE AS push_date, mode, id FROM logs WHERE success = 1
      AND (push_time::DATE, mode) NOT IN (SELECT (push_time::DATE, mode) FROM logs, (SELECT min(push_time)::DATE AS a, max(push_time)::DATE AS b FROM logs)
        WHERE push_time < a + ((b - a) // 2)::INT AND mode = 'intraday' AND success = 1)
      QUALIFY row_number() OVER (PARTITION BY push_time::DATE, mode ORDER BY push_time, id) = 1""", LOGS)
    o["ops_payloads"] = query("""SELECT id, CASE WHEN whole THEN mode END AS mode, CASE WHEN whole THEN 2 * signal_count END AS second,
      CASE WHEN whole THEN success = 1 END AS ok, CASE WHEN whole THEN duration_ms END AS took, NULL::INT AS third, NULL::INT AS wrong,
      CASE WHEN id % 17 = 5 THEN 'missing' WHEN id % 13 = 4 THEN 'malformed' ELSE 'read' END AS status
      FROM (SELECT *, id % 17 <> 5 AND id % 13 <> 4 AS whole FROM logs)""", LOGS)
    o["dq_enum_violations"] = query("""SELECT 'event_type' AS "column", event_type AS value, count(*) AS rows FROM logs
      WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 2
      UNION ALL SELECT 'mode', mode, count(*) FROM logs WHERE mode NOT IN ('intraday') GROUP BY 2""", LOGS)
    o["dq_fk_orphans"] = query("SELECT user_id, count(*) AS events FROM events WHERE user_id NOT IN (SELECT user_id FROM users WHERE user_id % 10 <> 7) GROUP BY 1", USERS)
    o["ops_log_append"] = """SELECT event_id, '{"type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS payload, 2 AS items FROM events"""
    o["events_by_local_day"] = "SELECT (ts + INTERVAL 8 HOUR)::DATE AS day, count(*) AS events FROM events GROUP BY 1"
    o["update_run_counters"] = query('''SELECT status, count(*) AS symbols, coalesce(sum(rows), 0)::BIGINT AS rows FROM
      (SELECT u.sym, rows, CASE WHEN usable IS NULL THEN 'failed' WHEN usable = 0 THEN 'error' WHEN rows > 0 THEN 'updated' ELSE 'skipped' END AS status FROM universe u LEFT JOIN
        (SELECT b.sym, count(*) FILTER (sym % 9 <> 4) AS usable, count(*) FILTER (sym % 9 <> 4 AND sym % 5 <> 0 AND (d > latest OR latest IS NULL)) AS rows FROM bars b LEFT JOIN
          (SELECT sym AS s, max(d) AS latest FROM bars WHERE d < DATE '2000-06-01' GROUP BY 1) l ON l.s = b.sym WHERE sym % 7 <> 0 GROUP BY 1) p USING (sym)) GROUP BY 1''', UNIVERSE, BARS)
    return o
