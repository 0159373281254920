"""Subscriber, delivery-log and metric tables: state, transitions, reports and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbars.params import PLANS

TIMED = ["trial", "monthly", "quarterly", "yearly"]
MODES = ["intraday", "after_hours"]


def plan_table(spark: SparkSession) -> DataFrame:
    """The six plans as a literal dimension."""
    rows = F.array(*[F.struct(F.lit(p).alias("plan"), F.lit(d).cast("int").alias("duration"), F.lit(s).alias("has_signals"))
                     for p, d, s, _ in PLANS])
    return spark.range(1).select(F.inline(rows))


def plan_value(plan: Column, index: int, default) -> Column:
    out = None
    for row in PLANS:
        out = F.when(plan == row[0], F.lit(row[index])) if out is None else out.when(plan == row[0], F.lit(row[index]))
    return out.otherwise(F.lit(default))


def subscription_state(users: DataFrame, now: Column) -> DataFrame:
    active = F.coalesce(F.col("plan_expire") > now, F.lit(True)) & F.col("is_subscribed")
    left = F.when(F.col("plan_expire").isNotNull(), F.greatest(F.datediff("plan_expire", now), F.lit(0)))
    return users.select(
        "user_id", "plan", active.alias("is_active"),
        (plan_value(F.col("plan"), 2, False) & active).alias("has_signals"), left.alias("days_remaining"))


def subscription_stats(users: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """Users per plan, zero-filled; an overdue timed plan counts as expired and inactive."""
    overdue = F.col("plan").isin(TIMED) & F.coalesce(F.col("plan_expire") < now, F.lit(False))
    rows = users.withColumns({"active": F.col("is_subscribed") & ~overdue,
                              "plan": F.when(overdue, "expired").otherwise(F.col("plan"))})
    counts = rows.groupBy("plan").agg(F.count(F.lit(1)).alias("users"), F.count_if("active").alias("active"))
    return plans.select("plan").join(counts, "plan", "left").select(
        "plan", F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("active", F.lit(0)).alias("active"))


def active_subscribers(users: DataFrame, now: Column) -> DataFrame:
    ok = F.col("is_subscribed") & F.col("plan").isin(TIMED) & F.coalesce(F.col("plan_expire") > now, F.lit(True))
    return users.agg(F.count_if(ok).alias("active"))


def overdue(now: Column) -> Column:
    return F.col("plan").isin(TIMED) & F.col("plan_expire").isNotNull() & (F.col("plan_expire") < now)


def expire(users: DataFrame, now: Column) -> DataFrame:
    """New user snapshot with overdue plans set to expired."""
    return users.withColumn("plan", F.when(overdue(now), "expired").otherwise(F.col("plan")))


def expire_events(users: DataFrame, now: Column) -> DataFrame:
    """Audit rows for the users expired by ``expire``, with the plan they had before."""
    return users.where(overdue(now)).select(
        "user_id", F.lit("plan_expire").alias("event_type"), F.col("plan").alias("from_plan"),
        F.lit("expired").alias("to_plan"), F.lit(0).cast("decimal(10,2)").alias("amount"))


def apply_upgrades(users: DataFrame, orders: DataFrame) -> DataFrame:
    """Latest paid order per user sets plan and expiry; reports the transition."""
    last = orders.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "new_plan")).alias("o"))
    day = F.to_date("o.ts")
    changed = F.col("o").isNotNull()
    return users.join(last, "user_id", "left").select(
        "user_id", F.col("plan").alias("from_plan"),
        F.when(changed, F.col("o.new_plan")).otherwise(F.col("plan")).alias("to_plan"),
        F.when(changed, F.date_add(day, plan_value(F.col("o.new_plan"), 1, 0).cast("int"))).otherwise(F.col("plan_expire")).alias("plan_expire"),
        (F.col("is_subscribed") | changed).alias("is_subscribed"))


def upsert_users(users: DataFrame, follows: DataFrame) -> DataFrame:
    """Follow / unfollow events merged by user: known users only change their flag, new ones start a trial."""
    last = follows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "follow")).alias("f"))
    rows = users.join(last, "user_id", "full_outer").where("plan is not null or f.follow")
    return rows.select(
        "user_id", F.coalesce("plan", F.lit("trial")).alias("plan"),
        F.coalesce("f.follow", "is_subscribed").alias("is_subscribed"),
        F.when(F.col("plan").isNull(), F.date_add(F.to_date("f.ts"), 7)).otherwise(F.col("plan_expire")).alias("plan_expire"))


def new_deliveries(batch: DataFrame, done: DataFrame) -> DataFrame:
    """First successful delivery of each (date, mode) that has not been delivered before."""
    day = F.to_date("push_time")
    first = batch.where("success = 1").withColumn("push_date", day).groupBy("push_date", "mode").agg(
        F.min(F.struct("push_time", "id")).alias("p"))
    seen = done.where("success = 1").select(day.alias("push_date"), "mode").distinct()
    return first.join(seen, ["push_date", "mode"], "left_anti").select("push_date", "mode", F.col("p.id").alias("id"))


def report(logs: DataFrame, now: Column, days: int) -> DataFrame:
    """Daily pushes of the last days with the totals of the whole period (grouping sets in one pass)."""
    recent = logs.where(F.col("push_time") >= F.timestamp_add("DAY", F.lit(-days), now)).withColumn("day", F.to_date("push_time"))
    n = F.count(F.lit(1))
    return recent.rollup("day").agg(
        n.alias("pushes"), F.sum("signal_count").alias("signals"), F.sum("success").alias("succeeded"),
        F.round(F.sum("success") / n, 4).alias("success_rate"), F.round(F.sum("signal_count") / n, 4).alias("avg_signals"),
        F.round(F.sum("duration_ms") / n / 1000.0, 4).alias("avg_duration"))


def recent_metrics(events: DataFrame, name: str, now: Column, hours: int, most: int = 500) -> DataFrame:
    since = F.timestamp_add("HOUR", F.lit(-hours), now)
    return events.where((F.col("event_type") == name) & (F.col("ts") >= since)).orderBy(F.desc("ts"), "event_id").limit(most)


def violations(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Rows breaking an enum constraint, counted by column and value."""
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), (~F.col(c).isin(v)).alias("bad")) for c, v in allowed.items()]
    return df.select(F.inline(F.array(*rows))).where("bad").groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def append_log(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Append log entries to a table and return the whole of it."""
    log_row(rows).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def read_payloads(rows: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Fields of JSON payloads by (path, type), parsed once a row: null where a field is missing or of another kind.

    ``status`` tells whole payloads (read) from text that is no JSON (malformed) and from null (missing).
    """
    parsed = rows.withColumn("_variant", F.try_parse_json("payload"))
    status = F.when(F.col("payload").isNull(), "missing").when(F.col("_variant").isNull(), "malformed").otherwise("read")
    return parsed.select("*", *(F.try_variant_get("_variant", path, kind).alias(name) for name, (path, kind) in fields.items()), status.alias("status")).drop("_variant")


def local_day(ts: Column | str, zone: str) -> Column:
    """The date of a UTC time where ``zone`` is the local time."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def update_counters(symbols: DataFrame, cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Outcome of an update run: symbols with newer rows, with none, without an answer, or with unusable rows, and rows added."""
    last = cached.groupBy("sym").agg(F.max("d").alias("latest"))
    usable = (F.col("close") > 0) & (F.col("volume") > 0)
    newer = F.coalesce(F.col("d") > F.col("latest"), F.lit(True)) & usable
    per = fetched.join(last, "sym", "left").groupBy("sym").agg(
        F.count_if(newer).alias("rows"), F.count_if(usable).alias("usable"))
    status = F.when(F.col("usable").isNull(), "failed").when(F.col("usable") == 0, "error").when(F.col("rows") > 0, "updated").otherwise("skipped")
    return symbols.select("sym").join(per, "sym", "left").groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("symbols"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def log_row(events: DataFrame) -> DataFrame:
    """Log entry with a JSON payload, as appended to an audit or metric table."""
    payload = F.to_json(F.struct(F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    return events.select("event_id", payload.alias("payload"), F.size(F.array("user_id", "event_id")).alias("items"))
