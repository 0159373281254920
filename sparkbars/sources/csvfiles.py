"""Bars as CSV files, in one folder or one file a symbol, and a report of what could not be read."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbars.functions.windows import dealt

CSV_SCHEMA = "d date, open double, high double, low double, close double, volume double"
BROKEN = "broken_line"


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files per symbol, which holds its bars: one a date at most.

    Each task moves its own files into place as it commits (file names are those of the task, so a repeated task writes the same
    ones); the driver would otherwise move one file after another at the end.
    """
    (dealt(df).write.mode("overwrite").option("header", True)
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("sym").csv(path))


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _list_by_core(spark: SparkSession) -> None:
    """Folders are listed by a few tasks a core, for the session if it has Spark's default: up to 10,000 tasks of a folder or so each."""
    if spark.conf.get(LISTING) == "10000":
        spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    _list_by_core(spark)
    return spark.read.schema(CSV_SCHEMA + ", sym bigint").option("header", True).csv(path).select("sym", "d", "open", "high", "low", "close", "volume")


def write_files(lines: DataFrame, path: str) -> None:
    """One file <symbol>.csv a symbol of (sym, value): texts with their line ends, next to each other in the order of their file.

    Hadoop starts two processes for every file that it makes on a local file system (chmod, for the file and its checksum), which
    takes a hundred times as long as the file; so tasks make local files themselves. A file appears whole, under its last name; a repeated
    task makes the same one. Other file systems are written by Spark, one folder sym=<symbol> a symbol.
    """
    spark = lines.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() != "file":
        return write_folders(lines, path)
    fs.mkdirs(top)
    folder = fs.makeQualified(top).toUri().getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, name, file, attempt = 0, None, None, TaskContext.get().taskAttemptId()
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            ends, texts, first = runs.run_ends.to_pylist(), batch.column(1).cast(pa.large_binary()), 0
            _, offsets, data = texts.buffers()
            places = memoryview(offsets).cast("q")[texts.offset:]
            for this, end in zip(runs.values.to_pylist(), ends, strict=True):
                if this != name:
                    if file:
                        file.close()
                        os.replace(file.name, f"{folder}/{name}.csv")
                    name, file, made = this, open(f"{folder}/.{this}.{attempt}", "wb"), made + 1
                file.write(memoryview(data)[places[first]:places[end]] if data else b"")
                first = end
        if file:
            file.close()
            os.replace(file.name, f"{folder}/{name}.csv")
        yield pa.RecordBatch.from_pydict({"made": [made]}, pa.schema([("made", pa.int64())]))

    named = lines.select(F.coalesce(F.col("sym").cast("string"), F.lit("null")).alias("name"), "value")
    named.mapInArrow(write, "made long").agg(F.sum("made")).collect()


def write_folders(lines: DataFrame, path: str) -> None:
    """The files of ``write_files`` written by Spark, one folder sym=<symbol> a symbol; tasks move them into place, as in ``write_csv``."""
    whole = lines.select("sym", F.regexp_replace("value", r"\n\z", "").alias("value"))
    whole.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("sym").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, bar columns, broken_line): a line that is no bar keeps its text and has no values."""
    _list_by_core(spark)
    reader = spark.read.schema(f"{CSV_SCHEMA}, {BROKEN} string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
    reader = reader.option("inputBufferSize", 1 << 16)  # by default two megabytes are made anew for every file
    return reader.option("recursiveFileLookup", True).csv(path).select(F.col("_metadata.file_path").alias("file"), "*")


def _symbol(file) -> F.Column:
    """The name of a file <symbol>.csv without its ending, or of its folder sym=<symbol>."""
    name, ending = F.substring_index(file, "/", -1), F.length(F.substring_index(file, ".", -1)) + 1
    folder = F.substring_index(F.substring_index(file, "/", -2), "/", 1)  # no patterns: it is worked out for every line
    return F.when(folder.startswith("sym=") & (F.length(folder) > 4), F.substring(folder, 5, 1 << 30)).when(
        F.contains(name, F.lit(".")), F.left(name, F.length(name) - ending)).otherwise("")


def _broken() -> F.Column:
    """Is a line no bar? It names every column, since a cell is only parsed, and found wrong, if its column is asked for."""
    cells = [F.col(c.split()[0]).cast("string") for c in CSV_SCHEMA.split(", ")]
    return F.col(BROKEN).isNotNull() | F.col("d").isNull() | F.coalesce(*cells).isNull()


def read_csv_per_symbol(spark: SparkSession, path: str) -> DataFrame:
    """Whole bars of a folder of files per symbol; broken lines are left to the report."""
    good = _lines(spark, path).where(~_broken())
    return good.select(_symbol(F.col("file")).alias("sym"), "d", "open", "high", "low", "close", "volume")


def csv_report(spark: SparkSession, path: str) -> DataFrame:
    """(sym, rows, broken, first_broken, status) of every file's symbol: complete, broken (some lines are no bars) or empty.

    Files are listed by name, so one without a byte is there too; lines are counted where they are read.
    """
    broken, lines = _broken(), _lines(spark, path)
    # from the driver's own listing, as one text: scans skip files of no bytes
    names = spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", lines._jdf.inputFiles()).split("\n")
    files = spark.createDataFrame(pa.table({"file": [name for name in names if name]}))
    per = lines.groupBy(_symbol(F.col("file")).alias("sym")).agg(
        F.count_if(~broken).alias("rows"), F.count_if(broken).alias("broken"), F.min(F.when(broken, F.col(BROKEN))).alias("first_broken"))
    known = files.select(_symbol(F.col("file")).alias("sym")).distinct().join(per, "sym", "left")
    status = F.when(F.col("broken") > 0, "broken").when(F.col("rows") > 0, "complete").otherwise("empty")
    return known.select("sym", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("broken", F.lit(0)).alias("broken"), "first_broken", status.alias("status"))
