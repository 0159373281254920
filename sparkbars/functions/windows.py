"""Window and null-handling helpers shared by all operators."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per block for recurrences; see ``ewm``.
BLOCK = 512
# Fixed-point scale of running price sums.
FIXED = 1e9


@lru_cache(maxsize=256)
def _frame(context: SparkContext, first: int | None, last: int | None):
    """Window specifications of an application, built once: a query names dozens of them, each some calls to the JVM."""
    order = Window.partitionBy("sym").orderBy("blk", "d")
    return order if last is None else order.rowsBetween(first, last)


def by_symbol():
    """Rows of one symbol in time order.

    ``blk`` never decreases with ``d`` so (blk, d) is the same order as (d); naming it
    lets every window, including the block windows of ``ewm``, reuse a single sort.
    """
    return _frame(SparkContext.getOrCreate(), None, None)


def last_n(n: int):
    return _frame(SparkContext.getOrCreate(), -(n - 1), 0)


def previous_n(n: int):
    return _frame(SparkContext.getOrCreate(), -n, -1)


def so_far():
    return _frame(SparkContext.getOrCreate(), Window.unboundedPreceding, 0)


def dealt(df: DataFrame) -> DataFrame:
    """Rows by symbol in three partitions a core (at most the session's shuffle partitions), for work that costs far more than its bytes.

    Partitions joined by their size come to about one a core, and the last of them runs alone; each task plans and compiles its
    windows anew, so very many partitions cost more than they spread.
    """
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * SparkContext.getOrCreate().defaultParallelism)
    return df.repartition(parts, "sym")


def sequence(bars: DataFrame) -> DataFrame:
    """Add the 1-based row number ``rn`` and recurrence block ``blk`` per symbol.

    Bars are unique on (sym, d), so one symbol never holds more rows than the calendar has
    dates; trade skew is absorbed earlier by the pre-aggregation that builds the bars.
    """
    bars = dealt(bars)
    w = Window.partitionBy("sym").orderBy("d")
    fixed = F.rint(F.col("close") * FIXED).cast("decimal(25,0)")  # its sums have 35 digits, so no series overflows them
    running = F.sum(fixed).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumns({"rn": F.row_number().over(w), "close_sum": running}).withColumn(
        "blk", F.floor((F.col("rn") - 1) / BLOCK).cast("int"))


def close_mean(n: int) -> Column:
    """Mean close of the last n rows as a difference of two running sums.

    The cost per row does not depend on n, and fixed-point sums lose nothing over time.
    """
    before = F.coalesce(F.lag("close_sum", n).over(by_symbol()), F.lit(0))
    return (F.col("close_sum") - before).cast("double") / F.least("rn", F.lit(n)) / FIXED


def prior(column, n: int = 1) -> Column:
    return F.lag(column, n).over(by_symbol())


def truth(condition: Column) -> Column:
    """A comparison with a missing operand counts as false."""
    return F.coalesce(condition, F.lit(False))


def seen_before(flag, n: int) -> Column:
    """Flag set on any of the previous n rows; the first row of a symbol counts as set."""
    return F.coalesce(F.max(flag).over(previous_n(n)), F.lit(True))


def any_in(flag, n: int) -> Column:
    return F.max(flag).over(last_n(n))


def count_in(flag, n: int) -> Column:
    return F.sum(F.col(flag).cast("int") if isinstance(flag, str) else flag.cast("int")).over(last_n(n))


def gated(aggregate, column, frame, minimum: int) -> Column:
    """Windowed aggregate that stays null until ``minimum`` non-null observations exist."""
    return F.when(F.count(column).over(frame) >= minimum, aggregate(column).over(frame))


def as_points(*flags: Column) -> Column:
    total = flags[0].cast("int")
    for flag in flags[1:]:
        total = total + flag.cast("int")
    return total


def half_even(column: Column, digits: int) -> Column:
    """Half-even rounding of the decimal value, without binary noise in the last digits."""
    return F.bround(F.round(column, digits + 4), digits)
