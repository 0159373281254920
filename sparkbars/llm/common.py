"""Shared helpers: reading tables, tables written to the shared folder, and bounded blocks of Arrow rows."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 19  # text bytes that a task works on at once
BATCH_ROWS = 1000      # rows of an Arrow batch; Spark's default is meant for rows without texts
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers on this machine find this package wherever they are started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Set the rows of Arrow batches for this session, unless its user has chosen them: texts of a batch are held several times over."""
    if spark.conf.get(ROWS_SETTING) == "10000":
        spark.conf.set(ROWS_SETTING, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
            folder = spark.sparkContext.getCheckpointDir()
    return folder


class Scratch:
    """Parquet tables in the shared folder that cut lineage: later jobs read them again after the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.base = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.scratch_path = path
        return saved

    def drop(self, *saved: DataFrame) -> None:
        """Delete tables that no later result reads."""
        for df in saved:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty, and the n + 1 offsets of its texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return a worker's free memory to the machine; workers are kept, and else hold what their largest task took."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim:
            trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut batches into blocks of at most `limit` text bytes and `rows` rows; a longer text is a block of its own."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        row = 0
        while row < len(batch):
            end = min(row + rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
            yield batch.slice(row, end - row)
            row = end
    give_back()


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def tiles(queries: DataFrame, rows: DataFrame, groups: int) -> DataFrame:
    """Each block of queries (its columns prefixed by query_) beside each block of rows of the same `dim`.

    Blocks of rows are dealt in turn to `groups` keys and blocks of queries copied to all, so that the work, not the bytes, decides
    on the number of tasks; four times as many partitions keep most keys apart.
    """
    named = [F.col(c).alias(f"query_{c}") for c in queries.columns if c != "dim"]
    left = queries.select("dim", *named, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("tile_group"))
    dealt = F.pmod(F.monotonically_increasing_id() + 7 * F.spark_partition_id(), F.lit(groups)).cast("int")
    left, right = (x.repartition(4 * groups, "dim", "tile_group") for x in (left, rows.withColumn("tile_group", dealt)))
    return left.join(right.hint("merge"), ["dim", "tile_group"]).drop("tile_group")
