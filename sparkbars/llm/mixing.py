"""Mixing sources to target weights: repetition rates from size totals, each document kept floor(rate) times and one more by a hashed coin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (3, 1, 2)  # of the sources in order, over and over
SHARE = (3, 2)       # all targets together, as a fraction of all sizes
MOST = 2             # a target is at most this many times its source's size
WORD = r"[^\x20\x09-\x0D]+"
COIN_DIGITS = 13     # hexadecimal digits of a coin: 52 bits, exact in a double


def coin(docs: DataFrame, seed: str) -> Column:
    """A number of 0 to 1 (exclusive) from the row's id, source and text alone."""
    held = [F.coalesce(docs[c].cast("string"), F.lit("")) for c in ("doc_id", "source")] + [F.coalesce(F.md5(docs["text"].cast("binary")), F.lit(""))]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *held).cast("binary")), 1, COIN_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**COIN_DIGITS))


def _weighed(scratch: Scratch, sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """(source, source_size) with a weight by place in code point order, null last: places come from counts of ranges, so no task sorts all sources."""
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    turn = F.array(*(F.lit(w) for w in weights))[(place % len(weights)).cast("int")]
    return scratch.save(dealt.join(counts, "part").select("source", "source_size", turn.cast("decimal(38,0)").alias("weight")))


def targets(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """docs(source, size) -> (source, source_size, target): shares of the whole by weight, none above `most` times its source's size.

    A source whose share is above its bound keeps the bound, and what is over goes to the others by weight, until none is above.
    Each round is a sum over the table of sources, and three numbers come to the driver; the bound is compared in whole
    numbers, so the result does not depend on the order of sums. A null source is a source of its own, the last one.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sums = docs.groupBy("source").agg(F.sum("size").cast("decimal(38,0)").alias("source_size"))
    known = _weighed(scratch, sums, weights)
    up, down = share
    stopped, held = F.lit(False), -1
    while True:
        free = ~stopped
        total = known.agg(F.count_if(stopped), F.sum("source_size"), F.sum(F.when(stopped, F.col("source_size"))), F.sum(F.when(free, F.col("weight")))).first()
        count, size, full, weight = (int(x or 0) for x in total)
        rest = up * size - down * most * full  # what the others share, times `down`
        level = rest / down / weight if weight else 0.0
        if count == held or not weight:
            break
        held = count
        bound = F.col("source_size") * F.lit(most * down).cast("decimal(6,0)")
        stopped = F.col("weight").cast("decimal(9,0)") * F.lit(rest).cast("decimal(25,0)") > bound.cast("decimal(25,0)") * F.lit(weight).cast("decimal(12,0)")
    target = F.when(stopped, F.col("source_size").cast("double") * most).otherwise(F.col("weight").cast("double") * F.lit(level))
    return known.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """docs(doc_id, text, source, ...) -> docs and (size, source_size, target, copies): how often the mix takes each row.

    The size of a row is its number of words; null and empty texts have none, and their copies count nothing. A source's rate is
    its target by its size. Each row is taken floor(rate) times, and once more if its coin, a hash of id, source and text, is
    below the fraction; so reruns and lost executors change nothing, the words taken from a source come near its target as its
    documents grow in number, and no row is taken more than `most` times. Rows with the same id, source and text share their
    coin. A source without words has rate 0. A null source is a source. Columns of docs named like the new ones are replaced.
    Empty tables give empty results.

    Nothing but sizes is shuffled, summed within each task first. The table of sources is read back from the shared folder;
    Spark broadcasts it if its files are below its threshold, and joins by sorting, with hot sources split, if not.
    """
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    sized = docs.select(*kept, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    goals = targets(sized, weights, share, most).withColumnRenamed("source", "goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (coin(sized, seed) < rate - F.floor(rate)).cast("long")
    joined = sized.join(goals, sized["source"].eqNullSafe(goals["goal_source"])).drop("goal_source")
    return joined.withColumn("copies", copies)


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as it is taken, with its number in `copy`, from 1; rows taken no time are gone."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def taken(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
