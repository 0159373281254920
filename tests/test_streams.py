"""Streams in several batches, with late rows, replays and restarts, against the batch result."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sparkbars.streaming import streams as s

ROOT = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def put(spark, folder, rows):
    """One file of events (event_id, minute, user_id, event_type, value)."""
    full = [(i, at(m), u, kind, float(v), '{"k": 1}') for i, m, u, kind, v in rows]
    spark.createDataFrame(full, s.EVENTS).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def parts(spark, folder, base=None):
    """The events in three files by time; the stream is to be run after each, and, with a base, once more after a closing mark."""
    events = spark.read.schema(s.EVENTS).parquet(f"{ROOT}/events.parquet")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [low + (high - low) * k / 3 for k in range(4)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        last = F.col("ts") <= b if b == high else F.col("ts") < b
        events.where((F.col("ts") >= a) & last).coalesce(1).write.mode("append").parquet(folder)
        yield stream(spark, folder, base)
    if base:
        s.close(spark, base, high + dt.timedelta(days=2))
        yield stream(spark, folder, base)


def stream(spark, folder, base=None):
    raw = s.events(spark, folder)
    return s.as_ticks(s.with_marks(raw, base) if base else raw)


def everything(spark):
    return s.as_ticks(spark.read.schema(s.EVENTS).parquet(f"{ROOT}/events.parquet"))


def test_bars_of_three_runs_are_those_of_one(spark, tmp_path):
    for ticks in parts(spark, str(tmp_path / "in")):
        log = s.run_log(s.ohlcv(ticks), "bars", str(tmp_path / "run"))
    got = sorted(s.newest(log, ["sym", "start"]).select("sym", "start", "close", "volume").collect())
    want = everything(spark).groupBy("sym", F.date_trunc("hour", "ts").alias("start")).agg(
        F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.sum("volume").alias("volume"))
    assert got == sorted(want.collect())
    again = s.run_log(s.ohlcv(ticks), "bars", str(tmp_path / "run"))  # a restart without news
    assert sorted(s.newest(again, ["sym", "start"]).select("sym", "start", "close", "volume").collect()) == got


def test_sessions_over_three_runs_are_written_once(spark, tmp_path):
    counts = []
    for ticks in parts(spark, str(tmp_path / "in"), str(tmp_path / "run")):
        got = s.run(s.sessions(ticks, "6 hours"), "sessions", str(tmp_path / "run"))
        counts.append(got.count())
    plain = everything(spark).groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("events"), F.sum("volume").alias("volume"))
    want = sorted(plain.select("user_id", F.col("w.start").alias("start"), "events", "volume").collect())
    assert sorted(got.collect()) == want and 0 < counts[0] < counts[1] < counts[2] < counts[3] == len(want)
    again = s.run(s.sessions(stream(spark, str(tmp_path / "in"), str(tmp_path / "run")), "6 hours"), "sessions", str(tmp_path / "run"))
    assert again.count() == len(want)


def test_a_session_over_three_batches(spark, tmp_path, few_partitions):
    folder, base = str(tmp_path / "in"), str(tmp_path / "run")
    for k, rows in enumerate(([(1, 0, 7, "a", 1), (2, 20, 7, "a", 1)], [(3, 45, 7, "a", 1), (4, 46, 8, "a", 1)], [(5, 70, 7, "a", 1), (6, 200, 7, "a", 1)])):
        put(spark, folder, rows)
        got = s.run(s.sessions(stream(spark, folder, base)), "sessions", base)
        assert k == 2 or got.count() == 0
    s.close(spark, base, at(500))
    got = s.run(s.sessions(stream(spark, folder, base)), "sessions", base)
    assert sorted((r.user_id, r.start, r.events) for r in got.collect()) == [(7, at(0), 4), (7, at(200), 1), (8, at(46), 1)]


def test_a_latch_over_three_runs_touches_new_bars_only(spark, tmp_path, few_partitions):
    folder, base = str(tmp_path / "in"), str(tmp_path / "run")
    closes = [("a", 0, 25), ("b", 0, 1), ("a", 1, 10), ("b", 1, 30), ("a", 2, 4), ("c", 2, 6), ("a", 3, 6), ("b", 3, 9), ("a", 4, 20), ("c", 4, 5)]
    seen = 0
    for hours in ((0, 1), (2,), (3, 4)):
        rows = [(sym, at(60 * h), float(c)) for sym, h, c in closes if h in hours]
        spark.createDataFrame(rows, "sym string, start timestamp, close double").coalesce(1).write.mode("append").parquet(folder)
        bars = spark.readStream.schema("sym string, start timestamp, close double").parquet(folder)
        got = s.run(s.latch(bars, 20.0, 5.0), "latch", base)
        seen += len(rows)
        assert got.count() == seen
    again = s.run(s.latch(bars, 20.0, 5.0), "latch", base)
    want = [("a", 0, 1), ("a", 1, 1), ("a", 2, 0), ("a", 3, 0), ("a", 4, 1), ("b", 0, 0), ("b", 1, 1), ("b", 3, 1), ("c", 2, 0), ("c", 4, 0)]
    assert sorted((r.sym, r.start, r.state) for r in again.collect()) == [(x, at(60 * h), on) for x, h, on in want]
    spark.createDataFrame([("a", at(0), 1.0), ("d", at(0), 30.0)], "sym string, start timestamp, close double").write.mode("append").parquet(folder)
    late = s.run(s.latch(bars, 20.0, 5.0), "latch", base)
    assert sorted((r.sym, r.start, r.state) for r in late.collect()) == sorted([(x, at(60 * h), on) for x, h, on in want] + [("d", at(0), 1)])


def test_a_quote_never_sees_a_later_close(spark, tmp_path, few_partitions):
    quotes, closes, base = str(tmp_path / "q"), str(tmp_path / "c"), str(tmp_path / "run")
    kind = "key string, known timestamp, adjusted double, raw double"
    spark.createDataFrame([], kind).write.parquet(closes)

    def run():
        left = s.as_ticks(s.with_marks(s.events(spark, quotes), base)).select("event_id", F.col("sym").alias("key"), "ts", "price")
        right = spark.readStream.schema(kind).parquet(closes)
        return s.run(s.splice(left, right, "2 hours"), "splice", base)

    put(spark, quotes, [(1, 59, 0, "a", 10), (2, 60, 0, "a", 10), (3, 61, 0, "b", 10)])
    spark.createDataFrame([("a", at(60), 4.0, 2.0)], kind).coalesce(1).write.mode("append").parquet(closes)
    assert run().count() == 0  # nothing is certain yet
    put(spark, quotes, [(4, 130, 0, "a", 10), (5, 65, 0, "a", 10), (6, 179, 0, "a", 10), (7, 400, 0, "a", 10)])
    spark.createDataFrame([("a", at(120), 6.0, 2.0), ("b", at(120), 6.0, 2.0), ("a", at(180), 0.0, 2.0)], kind).coalesce(1).write.mode("append").parquet(closes)
    run()
    s.close(spark, base, at(2000))
    spark.createDataFrame([("", at(2000), None, None)], kind).write.mode("append").parquet(closes)
    run()
    got = {r.event_id: r.price for r in run().collect()}
    assert got == {1: 10.0, 2: 20.0, 3: 10.0, 4: 30.0, 5: 20.0, 6: 30.0, 7: 10.0}


@pytest.mark.parametrize("age", ["45 minutes", "1 day"])
def test_a_quote_meets_the_closes_of_its_time_only(spark, age):
    length = dt.timedelta(days=1) if "day" in age else dt.timedelta(minutes=45)
    closes = [("a", at(20 * k), float(k + 1)) for k in range(300)]
    times = [at(37 * k) for k in range(160)] + [at(20 * k) + length for k in range(0, 300, 7)]  # the last lie at the end of an age
    left = spark.createDataFrame([(i, "a", ts, 1.0) for i, ts in enumerate(times)], "event_id long, key string, ts timestamp, price double")
    right = spark.createDataFrame([(k, ts, c, 1.0) for k, ts, c in closes], "key string, known timestamp, adjusted double, raw double")
    spliced = s.splice(left, right, age)
    want = {i: max((c for _, known, c in closes if ts - length < known <= ts), default=1.0) for i, ts in enumerate(times)}  # closes grow
    assert {r.event_id: r.price for r in spliced.collect()} == want
    assert "cell#" in re.search(r"Join\w* .*", spliced._jdf.queryExecution().optimizedPlan().toString()).group()


def test_late_rows_of_many_batches_and_a_restart(spark, tmp_path, few_partitions):
    folder, base = str(tmp_path / "in"), str(tmp_path / "run")
    put(spark, folder, [(0, 10_000, 0, "a", 1)])

    def run():
        raw = spark.readStream.schema(s.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        return s.counted(s.dedup(s.as_ticks(raw)), "late", base).first()

    assert run() == (1, 0)
    events = spark.createDataFrame([(i, at(i), 0, "a", 1.0, "{}") for i in range(1, 129)], s.EVENTS).repartitionByRange(128, "event_id")
    events.write.mode("append").parquet(folder)
    first = run()
    put(spark, folder, [(500, 20_000, 0, "a", 1)])
    second = run()
    files = spark.read.schema(s.EVENTS).parquet(folder).select(F.input_file_name()).distinct().count()
    assert files > 101 and first == (1, 128) and second == (2, 128) and run() == second


def test_published_once_over_batches_replays_and_runs(spark, tmp_path, few_partitions):
    folder, base = str(tmp_path / "in"), str(tmp_path / "run")

    def run():
        ticks = s.as_ticks(s.events(spark, folder))
        return sorted((str(r.push_date), r.mode, r.event_id, r.batch) for r in s.publish(
            ticks.select(F.to_date("ts").alias("push_date"), F.col("sym").alias("mode"), "ts", "event_id"), "publish", base).collect())

    put(spark, folder, [(2, 5, 0, "x", 1), (1, 4, 0, "x", 1), (3, 5, 0, "y", 1)])
    assert run() == [("2024-01-01", "x", 1, 0), ("2024-01-01", "y", 3, 0)]
    put(spark, folder, [(0, 1, 0, "x", 1), (9, 1500, 0, "x", 1)])  # an earlier row of a key that is out, and a new date
    second = run()
    assert second == [("2024-01-01", "x", 1, 0), ("2024-01-01", "y", 3, 0), ("2024-01-02", "x", 9, 1)]
    (tmp_path / "run" / "checkpoint" / "commits" / "1").unlink()  # as if the run had died before the last batch was committed
    (tmp_path / "run" / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert run() == second
