"""A bar table partitioned by symbol bucket. A change rewrites the buckets it touches and reads no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbars.operators import maintenance
from sparkbars.sources.tables import scratch

SCHEMA = "sym bigint, d date, open double, high double, low double, close double, volume double"
BUCKETS = 32  # a table's own number; more for larger tables, so that a bucket stays a few files


def bucket(sym: Column) -> Column:
    return F.pmod(F.xxhash64(sym.cast("bigint")), F.lit(BUCKETS)).cast("int")


def _laid(bars: DataFrame) -> DataFrame:
    """Rows by bucket, files sized by the data, sorted so that a reader of one symbol skips other row groups."""
    rows = bars.select(*maintenance.COLUMNS, bucket(F.col("sym")).alias("bucket"))
    return rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "sym", "d")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, bucket int").parquet(path)


def create(bars: DataFrame, path: str) -> None:
    _laid(bars).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).drop("bucket")


def read_symbol(spark: SparkSession, path: str, sym: int) -> DataFrame:
    """The bars of one symbol: one bucket is listed, and the symbol reaches the scan of its sorted files."""
    return _stored(spark, path).where((F.col("bucket") == bucket(F.lit(sym))) & (F.col("sym") == sym)).drop("bucket")


def touched(spark: SparkSession, path: str, keys: DataFrame) -> tuple[DataFrame, list[int]]:
    """The rows of the buckets that hold the symbols of ``keys``, and those buckets' numbers, at most BUCKETS."""
    numbers = sorted(r.bucket for r in keys.select(bucket(F.col("sym")).alias("bucket")).distinct().collect())
    return _stored(spark, path).where(F.col("bucket").isin(numbers)).drop("bucket"), numbers


def change(spark: SparkSession, path: str, keys: DataFrame, made: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the buckets of the symbols of ``keys`` by ``made`` of their rows.

    The new buckets are written in full to the shared folder before the table is touched, and taken from there: a failure while
    they are computed changes nothing, and no job overwrites what it reads.
    """
    rows, numbers = touched(spark, path, keys)
    staged = scratch(spark, "buckets")
    _laid(made(rows)).write.partitionBy("bucket").parquet(staged)
    after = _stored(spark, staged)
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    filled = {r.bucket for r in after.select("bucket").distinct().collect()}
    for number in set(numbers) - filled:  # overwriting by partition leaves those alone that have no row any more
        spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{path}/bucket={number}")


def replace(spark: SparkSession, path: str, symbols: DataFrame, rows: DataFrame | None = None) -> None:
    """Remove the given symbols, and those of ``rows``, and put ``rows``, if any, in their place."""
    gone = symbols.select("sym")
    if rows is not None:
        gone = gone.unionByName(rows.select("sym"))

    def made(old: DataFrame) -> DataFrame:
        kept = old.join(gone.distinct(), "sym", "left_anti").select(*maintenance.COLUMNS)
        return kept if rows is None else kept.unionByName(rows.select(*maintenance.COLUMNS))

    change(spark, path, gone, made)


def merge(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Write ``new`` over, or beside, the rows of the same symbol and date."""
    change(spark, path, new, lambda old: maintenance.merge_last(old, new))


def append_newer(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Add the rows of ``new`` that are later than all of their symbol; files are added, none is rewritten."""
    old, _ = touched(spark, path, new)
    _laid(maintenance.append_newer(old, new)).write.mode("append").partitionBy("bucket").parquet(path)
