"""Registered subscriber, delivery-log and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkbars.operators import ops
from sparkbars.sources import views
from sparkbars.sources.tables import scratch, table


def now():
    return F.to_timestamp(F.lit(views.AS_OF))


def today():
    return F.to_date(now())


def _paid(spark, root):
    """Purchases as plan orders."""
    k = F.get_json_object("props", "$.k").cast("int") % 3
    plan = F.when(k == 0, "monthly").when(k == 1, "quarterly").otherwise("yearly")
    return table(spark, root, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id", plan.alias("new_plan"))


def _follows(spark, root):
    """Sign-ups follow, errors unfollow; some users are not known yet."""
    return table(spark, root, "events").where("event_type in ('signup', 'error')").select(
        F.when(F.col("event_id") % 50 == 0, F.col("user_id") + 1000000).otherwise(F.col("user_id")).alias("user_id"), "ts", "event_id",
        (F.col("event_type") == "signup").alias("follow"))


def ops_report(spark, root):
    return ops.report(views.push_logs(spark, root), now(), 7)


def metrics_recent(spark, root):
    return ops.recent_metrics(table(spark, root, "events"), "click", now(), 72).select("event_id", "ts", "value")


def ops_last_push(spark, root):
    return views.push_logs(spark, root).orderBy(F.desc("push_time"), "id").limit(1).select("push_time", "mode", "success")


def subscription_stats(spark, root):
    return ops.subscription_stats(views.users(spark, root), ops.plan_table(spark), today())


def active_subscribers(spark, root):
    return ops.active_subscribers(views.users(spark, root), today())


def subscription_state(spark, root):
    return ops.subscription_state(views.users(spark, root), today())


def subscription_expire(spark, root):
    return ops.expire(views.users(spark, root), today())


def subscription_expire_events(spark, root):
    return ops.expire_events(views.users(spark, root), today())


def subscription_upgrade(spark, root):
    return ops.apply_upgrades(views.users(spark, root), _paid(spark, root))


def user_upsert(spark, root):
    return ops.upsert_users(views.users(spark, root), _follows(spark, root))


def push_idempotent(spark, root, since=None, until=None):
    """Deliveries from ``since`` on (by default all), where the intraday ones before ``until`` (the middle of the log) are out already."""
    logs = views.push_logs(spark, root)
    if since is None or until is None:
        first, last = F.to_date(F.min("push_time")), F.to_date(F.max("push_time"))
        bounds = logs.select(F.min("push_time").alias("since"), F.date_add(first, F.floor(F.date_diff(last, first) / 2).cast("int")).alias("until")).first()
        since, until = since or bounds.since, until or bounds.until
    return ops.new_deliveries(logs.where(F.col("push_time") >= F.lit(since)), logs.where((F.col("push_time") < F.lit(until)) & (F.col("mode") == "intraday")))


def dq_enum_violations(spark, root):
    return ops.violations(views.push_logs(spark, root), {"event_type": ["click", "view", "purchase"], "mode": ["intraday"]})


def dq_fk_orphans(spark, root):
    """Events whose user does not exist, counted per user before the join."""
    per = table(spark, root, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    known = views.users(spark, root).where("user_id % 10 != 7").select("user_id")
    return per.join(known, "user_id", "left_anti")


def ops_log_append(spark, root):
    """Two appends to one log table, the later half of the events second."""
    path, events = scratch(spark, "log"), table(spark, root, "events")
    ops.append_log(spark, path, events.where("event_id % 2 = 0"))
    return ops.append_log(spark, path, events.where("event_id % 2 <> 0"))


def ops_payloads(spark, root):
    """Nested log payloads, some cut off and some missing, read as variants."""
    logs = views.push_logs(spark, root)
    payload = F.format_string('{"push":{"mode":"%s","counts":[%d,%d]},"ok":%s,"took":"%d"}', "mode", "signal_count", F.col("signal_count") * 2,
                              F.when(F.col("success") == 1, "true").otherwise("false"), "duration_ms")
    cut = F.substring(payload, F.lit(1), (F.length(payload) - F.col("id") % 29 - 1).cast("int"))
    payload = F.when(F.col("id") % 17 == 5, F.lit(None)).when(F.col("id") % 13 == 4, cut).otherwise(payload)
    fields = {"mode": ("$.push.mode", "string"), "second": ("$.push.counts[1]", "int"), "ok": ("$.ok", "boolean"), "took": ("$.took", "bigint"),
              "third": ("$.push.counts[2]", "int"), "wrong": ("$.push", "int")}
    return ops.read_payloads(logs.select("id", payload.alias("payload")), fields).drop("payload")


def events_by_local_day(spark, root):
    day = ops.local_day(F.col("ts").cast("timestamp"), "Asia/Shanghai")
    return table(spark, root, "events").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("events"))


def update_run_counters(spark, root):
    """Cached bars up to a date; the fetch misses every seventh symbol, brings nothing new for every fifth and stopped days for every ninth."""
    bars = views.bars(spark, root)
    cut = F.when(F.col("sym") % 5 == 0, F.lit("2099-01-01")).otherwise(F.lit("2000-06-01")).cast("date")
    fetched = bars.where("sym % 7 <> 0").withColumn("volume", F.when(F.col("sym") % 9 == 4, 0.0).otherwise(F.col("volume")))
    return ops.update_counters(views.universe(spark, root), bars.where(F.col("d") < cut), fetched)


def queries() -> dict:
    return {f.__name__: f for f in (
        ops_report, metrics_recent, ops_last_push, subscription_stats, active_subscribers, subscription_state, subscription_expire,
        subscription_expire_events, subscription_upgrade, user_upsert, push_idempotent, dq_enum_violations, dq_fk_orphans, ops_log_append, ops_payloads,
        events_by_local_day, update_run_counters)}
