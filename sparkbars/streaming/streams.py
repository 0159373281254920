"""Structured Streaming operators over a tick stream (sym, ts, price, volume).

Every stream runs to the end of its input with ``availableNow``; with the same ``base`` a later run resumes where the last one
stopped. Sessions, latches and quotes with their references are held in the state store and written once, when the watermark
has passed them; a closing mark (``close``) moves the watermark on when no more ticks come. Bars that may still change are
written in update mode to a log, one folder per micro-batch, of which a reader takes the newest row of each key; a retried
batch overwrites its own folder. State is bounded by watermarks, or by the number of symbols.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkbars.operators.maintenance import OHLC
from sparkbars.sources.tables import scratch

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
DELAY = "10 minutes"


def events(spark: SparkSession, path: str) -> DataFrame:
    # A pattern, because the file source takes a plain path for a partition root; it matches a file or a folder.
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1000).parquet(f"{path[:-1]}[{path[-1]}]")


def with_marks(stream: DataFrame, base: str) -> DataFrame:
    """The event stream and its closing marks, rows with nothing but a time: they move the watermark and belong to no symbol."""
    spark = stream.sparkSession
    spark.createDataFrame([], EVENTS).write.mode("ignore").parquet(f"{base}/marks")
    return stream.unionByName(events(spark, f"{base}/marks"))


def close(spark: SparkSession, base: str, ts) -> None:
    """Say that no tick before ``ts`` is to come; the next run closes what the watermark then passes."""
    spark.createDataFrame([(ts,)], "ts timestamp").selectExpr("null as event_id", "ts", *(f"null as {c}" for c in ("user_id", "event_type", "value", "props"))).select(
        *(F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], EVENTS).schema)).write.mode("append").parquet(f"{base}/marks")


def ticks(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """Event stream as ticks, with closing marks if there is a ``base``."""
    raw = events(spark, f"{root}/events.parquet")
    return as_ticks(with_marks(raw, base) if base else raw)


def as_ticks(raw: DataFrame) -> DataFrame:
    """The type is the symbol, the value the price."""
    return raw.select("event_id", "ts", "user_id", F.col("event_type").alias("sym"), F.col("value").alias("price"),
                      F.get_json_object("props", "$.k").cast("double").alias("volume"))


def run(df: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Run an append-mode stream to completion and return what it wrote."""
    spark, base = df.sparkSession, base or scratch(df.sparkSession, name)
    query = (df.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def run_log(df: DataFrame, name: str, base: str | None = None, each=None) -> DataFrame:
    """Run an update-mode stream to completion; return the log of its batches with the number of each in ``batch``.

    ``each`` is a static aggregation of one batch, where that suffices and the stream needs no state.
    """
    spark, base = df.sparkSession, base or scratch(df.sparkSession, name)
    each = each or (lambda batch: batch)
    schema = each(spark.createDataFrame([], df.schema)).schema
    spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{base}/log/batch=-1")

    def apply(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{base}/log/batch={number}")

    query = (df.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(f"{base}/log")


def newest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row of each key, combined before the shuffle."""
    values = [c for c in log.columns if c not in (*keys, "batch")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def ohlcv(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Ticks to bars in tumbling windows."""
    order = F.struct("ts", "event_id")
    return stream.withWatermark("ts", DELAY).groupBy(F.window("ts", width).alias("w"), "sym").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
    ).select("sym", F.col("w.start").alias("start"), *OHLC, "volume")


def sliding_volume(stream: DataFrame) -> DataFrame:
    """Volume of the last six hours, every hour, against the number of ticks."""
    return stream.withWatermark("ts", DELAY).groupBy(F.window("ts", "6 hours", "1 hour").alias("w"), "sym").agg(
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("ticks")).select("sym", F.col("w.start").alias("start"), "volume", "ticks")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user, kept in the state store and written once, when the watermark has passed their end."""
    return stream.withWatermark("ts", DELAY).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("volume").alias("volume")).select("user_id", F.col("w.start").alias("start"), "events", "volume")


def splice(quotes: DataFrame, closes: DataFrame, age: str = "1 day") -> DataFrame:
    """Live quotes in adjusted prices, by the newest close that was known at the quote's own time and is at most ``age`` old.

    quotes(event_id, key, ts, price), closes(key, known, adjusted, raw). Both streams wait for the other up to their watermarks;
    a quote without a usable close keeps its price, and each is written once.

    Time is cut into cells of one ``age``. A close goes to its own cell and all it may be used in (one more, since days and months
    differ in length), so a quote meets the closes around its time instead of all of its key.
    """
    width = F.expr(f"greatest(unix_micros(timestamp '1970-01-01 00:00:00Z' + interval {age}), 1)")

    def cell(time):
        return F.floor(F.unix_micros(time) / width).cast("long")

    left = quotes.withWatermark("ts", DELAY).withColumn("cell", cell(F.col("ts"))).alias("q")
    cells = F.sequence(cell(F.col("known")), cell(F.col("known") + F.expr(f"interval {age}")) + 1)
    right = closes.withWatermark("known", DELAY).withColumn("cell", F.explode(cells)).alias("c")
    near = F.expr(f"q.key = c.key and q.cell = c.cell and c.known <= q.ts and c.known > q.ts - interval {age}")
    joined = left.join(right, near, "left").select("q.event_id", "q.key", "q.ts", "q.price", "c.known", "c.adjusted", "c.raw")
    newest_close = F.max_by(F.struct("adjusted", "raw"), "known")
    found = joined.groupBy("ts", "event_id", "key", "price").agg(newest_close.alias("c"))
    usable = (F.col("c.raw") > 0) & (F.col("c.adjusted") > 0)
    ratio = F.coalesce(F.when(usable, F.col("c.adjusted") / F.col("c.raw")), F.lit(1.0))
    return found.select("event_id", "key", (F.col("price") * ratio).alias("price"))


def upsert(existing: DataFrame, log: DataFrame) -> DataFrame:
    """Bars of a stream written over, or added to, an existing table; (sym, start) is the key."""
    return newest(existing.withColumn("batch", F.lit(-1).cast("bigint")).unionByName(log), ["sym", "start"])


def latch(bars: DataFrame, upper: float, lower: float) -> DataFrame:
    """On/off state of each symbol after each of its bars: on from ``upper``, off from ``lower``, else as it was.

    A stream of closed bars(sym, start, close), oldest first; the state store keeps one row a symbol, and a batch touches only
    the symbols that have a bar in it. A bar no newer than the last one seen changes nothing and is left out.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, on = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("start")  # of one symbol in one batch
        rows = rows[rows["start"] > pd.Timestamp(last, unit="us")] if last is not None else rows
        event = rows["close"].map(lambda x: 1.0 if x >= upper else 0.0 if x <= lower else None).astype("float64")
        out = pd.DataFrame({"sym": rows["sym"], "start": rows["start"], "state": event.ffill().fillna(on).astype("int32")})
        if len(out):
            state.update((int(out["start"].iloc[-1].value // 1000), int(out["state"].iloc[-1])))
        yield out

    return bars.select("sym", "start", "close").groupBy("sym").applyInPandasWithState(
        step, "sym string, start timestamp, state int", "last long, state int", "append", GroupStateTimeout.NoTimeout)


def dedup(stream: DataFrame) -> DataFrame:
    """Repeated deliveries of one event removed while the watermark remembers it."""
    return stream.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"])


class LateRows(StreamingQueryListener):
    """Keeps the rows that each batch of one query dropped as late: one folder a batch, so a run that is resumed goes on counting."""

    def __init__(self, spark: SparkSession, name: str, folder: str):
        self.spark, self.name, self.folder, self.run, self.ended = spark, name, folder, None, threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        if event.progress.runId == self.run and late:
            self.spark.createDataFrame([(late,)], "late long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={event.progress.batchId}")

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.ended.set()


def counted(df: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Run an append-mode stream to completion; count the rows it has kept and those that came too late, in this run and before.

    Every batch reports its late rows to a listener, however many batches there are; the reports are kept beside the rows.
    """
    spark, base, name = df.sparkSession, base or scratch(df.sparkSession, name), f"{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([(0,)], "late long").write.mode("ignore").parquet(f"{base}/late/batch=-1")
    listener = LateRows(spark, name, f"{base}/late")
    spark.streams.addListener(listener)
    try:
        query = (df.writeStream.outputMode("append").queryName(name).format("parquet").option("path", f"{base}/out")
                 .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
        if not listener.ended.wait(600):
            raise TimeoutError("the end of the stream was not reported, so late rows may be missing")
    finally:
        spark.streams.removeListener(listener)
    late = spark.read.schema("late long, batch long").parquet(f"{base}/late").agg(F.sum("late"))
    return spark.read.schema(df.schema).parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("kept")).withColumn("late", late.scalar())


def first_pushes(batch: DataFrame) -> DataFrame:
    """First successful row of each (date, mode) in a batch."""
    return batch.groupBy("push_date", "mode").agg(F.min(F.struct("ts", "event_id")).alias("p")).select("push_date", "mode", "p.*")


def publish(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Publish the first successful row of each (date, mode) once, over all batches and runs; return what is published.

    What a batch publishes goes to the folder of its date and number. A batch leaves out the keys that earlier batches have
    published, reading the folders of its own dates only; when it is replayed it does not see what it wrote before, so it
    writes the same rows over them.
    """
    spark, base = stream.sparkSession, base or scratch(stream.sparkSession, name)
    kind = "mode string, ts timestamp, event_id long, push_date date, batch long"
    spark.createDataFrame([], kind).write.mode("ignore").partitionBy("push_date", "batch").parquet(f"{base}/published")

    def apply(batch: DataFrame, number: int) -> None:
        first = first_pushes(batch).persist()
        dates = [r.push_date for r in first.select("push_date").distinct().collect()]  # the calendar days of one batch
        published = spark.read.schema(kind).parquet(f"{base}/published").where(F.col("push_date").isin(dates) & (F.col("batch") < number))
        fresh = first.join(published.select("push_date", "mode"), ["push_date", "mode"], "left_anti").withColumn("batch", F.lit(number).cast("long"))
        writer = fresh.select("mode", F.col("ts").cast("timestamp").alias("ts"), "event_id", "push_date", "batch").write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("push_date", "batch").parquet(f"{base}/published")
        first.unpersist()

    query = (stream.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(kind).parquet(f"{base}/published")
