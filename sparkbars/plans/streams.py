"""Registered streaming queries: each runs its stream over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkbars.sources.tables import scratch, table
from sparkbars.streaming import streams as s

def _naive(df):
    """Window starts as zone-free timestamps, like the event table's own column."""
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _hours(spark, root, name):
    return s.run_log(s.ohlcv(s.ticks(spark, root)), name)


def stream_ohlcv_bars(spark, root):
    return _naive(s.newest(_hours(spark, root, "ohlcv"), ["sym", "start"]))


def stream_sliding_volume(spark, root):
    return _naive(s.newest(s.run_log(s.sliding_volume(s.ticks(spark, root)), "sliding"), ["sym", "start"]))


def _after(spark, root, days=2):
    """A time after all ticks, from which the streams are closed."""
    return table(spark, root, "events").agg(F.max(F.col("ts").cast("timestamp")) + F.expr(f"interval {days} days")).scalar()


def _closed(spark, root, name, make):
    """What a stream of all ticks writes once they are closed: a run, a closing mark, and a second run that resumes."""
    base = scratch(spark, name)
    s.run(make(s.ticks(spark, root, base)), name, base)
    s.close(spark, base, spark.range(1).select(_after(spark, root)).first()[0])
    return s.run(make(s.ticks(spark, root, base)), name, base), base


def stream_sessions(spark, root):
    return _naive(_closed(spark, root, "sessions", s.sessions)[0])


AGE = "6 hours"


def stream_quote_splice(spark, root):
    """Every tick as a quote on its symbol, by the newest hour that had closed by then; the raw close is a stand-in."""
    _, hours = _closed(spark, root, "closes", s.ohlcv)
    base, kind = scratch(spark, "splice"), "sym string, start timestamp, close double"

    def spliced():
        bars = spark.readStream.schema(kind).parquet(f"{hours}/{{out,marks}}")
        raw = (F.hour("start") % 7).cast("double")
        closes = bars.select(F.col("sym").alias("key"), (F.col("start") + F.expr("interval 1 hour")).alias("known"), F.col("close").alias("adjusted"), raw.alias("raw"))
        quotes = s.ticks(spark, root, base).select("event_id", F.col("sym").alias("key"), "ts", "price")
        return s.run(s.splice(quotes, closes, AGE), "splice", base)

    spliced()
    end = spark.range(1).select(_after(spark, root)).first()[0]
    s.close(spark, base, end)
    mark = spark.createDataFrame([("", end, None)], kind)  # a join drops rows without a key before they reach the watermark
    mark.write.mode("append").parquet(f"{hours}/marks")
    return spliced().select("event_id", "key", F.round("price", 6).alias("price"))


def stream_upsert_bars(spark, root):
    """An existing table with a stale bar in each symbol's first hour, and an old one the stream does not touch."""
    hour = F.date_trunc("hour", F.min("ts").cast("timestamp"))
    first = table(spark, root, "events").groupBy(F.col("event_type").alias("sym")).agg(hour.alias("hour"))
    stale = first.withColumn("start", F.explode(F.array("hour", F.lit("1990-01-01").cast("timestamp")))).drop("hour")
    stale = stale.withColumns({c: F.lit(0.5) for c in ("open", "high", "low", "close", "volume")})
    return _naive(s.upsert(stale, _hours(spark, root, "upsert")))


def stream_regime_latch(spark, root):
    """Closed hours feed a second stream, whose state is one latch a symbol."""
    _, hours = _closed(spark, root, "hours", s.ohlcv)
    bars = spark.readStream.schema("sym string, start timestamp, close double").parquet(f"{hours}/out")
    return _naive(s.run(s.latch(bars, 20.0, 5.0), "latch"))


def stream_dedup(spark, root):
    twice = s.ticks(spark, root).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return s.run(s.dedup(twice), "dedup").select("event_id", "sym", "price")


def stream_late_rows(spark, root):
    """The newer half of the events comes first; a second run resumes the stream, and the older half is behind its watermark."""
    base = scratch(spark, "late")
    events = table(spark, root, "events")
    middle = events.agg((F.min("event_id") + F.max("event_id")) / 2).scalar()
    for part in (F.col("event_id") > middle, F.col("event_id") <= middle):
        events.where(part).write.mode("append").parquet(f"{base}/events")
        result = s.counted(s.dedup(s.as_ticks(s.events(spark, f"{base}/events"))), "late", f"{base}/run")
    return result


def stream_publish(spark, root):
    ok = s.ticks(spark, root).where("sym != 'error'").select(
        F.to_date("ts").alias("push_date"), F.when(F.col("sym").isin("click", "view"), "intraday").otherwise("after_hours").alias("mode"), "ts", "event_id")
    return s.publish(ok, "publish").select("push_date", "mode", "event_id")


def queries() -> dict:
    return {f.__name__: f for f in (stream_ohlcv_bars, stream_sliding_volume, stream_sessions, stream_quote_splice, stream_upsert_bars,
                                    stream_regime_latch, stream_dedup, stream_late_rows, stream_publish)}
