"""The analytics views derived from the source tables.

Trades (lineitem) are folded to weekly bars in one aggregation that combines map-side, so a
symbol holding a third of all trades sends no more rows into the shuffle than any other.
Sums are kept in integers, which makes every price exact.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkbars.sources.tables import scratch, table

SMOOTH_BARS = 10


def _ratio(numerator: str, denominator: str) -> F.Column:
    """Integer division rounded half up."""
    return F.expr(f"(2 * ({numerator}) + ({denominator})) div (2 * ({denominator}))")


def _weekly(spark: SparkSession, root: str) -> DataFrame:
    """One aggregation with primitive buffers only, so it hashes and combines map-side.

    The order of trades in a week is packed into one number: weekday, order (54 bits), line (3 bits); others are an error.
    """
    day = F.to_date("l_shipdate")
    trades = table(spark, root, "lineitem").where("l_quantity > 0 and l_extendedprice > 0").select(
        F.col("l_suppkey").alias("sym"),
        F.date_sub(day, F.weekday(day)).alias("d"),
        F.when(F.col("l_orderkey").between(0, (1 << 54) - 1) & F.col("l_linenumber").between(0, 7),
               (F.weekday(day) * F.lit(1 << 54) + F.col("l_orderkey")) * 8 + F.col("l_linenumber"))
        .otherwise(F.raise_error(F.lit("order or line number out of range")).cast("bigint")).alias("place"),
        F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col("l_quantity").cast("bigint").alias("qty"),
    ).withColumn("tick", _ratio("cents", "100 * qty"))
    return trades.groupBy("sym", "d").agg(
        F.min_by("tick", "place").alias("op"), F.max("tick").alias("hi"), F.min("tick").alias("lo"),
        F.max_by("tick", "place").alias("cl"), F.sum("cents").alias("cents"), F.sum("qty").alias("qty"))


def _as_bars(df: DataFrame) -> DataFrame:
    prices = [(F.col(c) / 100.0).alias(n) for c, n in
              (("op", "open"), ("hi", "high"), ("lo", "low"), ("cl", "close"))]
    return df.select("sym", "d", *prices, F.col("qty").cast("double").alias("volume"))


def bars_raw(spark: SparkSession, root: str) -> DataFrame:
    """Weekly bars per symbol at traded prices (very noisy)."""
    return _as_bars(_weekly(spark, root))


_stored: dict[tuple, str] = {}
_lock = threading.RLock()  # a stored view may be derived from another


def _state(spark: SparkSession, path: str) -> tuple:
    """What a table's files look like: number, bytes, newest time and a sum over names, lengths and times; a table that changes has another."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = top.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(top)
    if status.isFile():
        return status.getLen(), status.getModificationTime()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)  # contents are not read
    each = F.xxhash64("path", "length", "modificationTime") % (1 << 40)
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"), F.sum(each)).first())


def stored(spark: SparkSession, root: str, name: str, derive, sources: tuple = ("lineitem",), by: tuple = ()) -> DataFrame:
    """A view derived from source tables once and kept as a table in the shared folder, so that no query reads the sources again for it.

    It is derived anew in each application, and whenever a file of a source has changed. ``by`` names partition columns.
    """
    key = (spark.sparkContext.applicationId, root, name, *(_state(spark, f"{root}/{source}.parquet") for source in sources))
    with _lock:
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{_stored[key]}/_SUCCESS") if key in _stored else None
        if mark is None or not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            path = scratch(spark, name)
            derive(spark, root).write.partitionBy(*by).parquet(path)
            _stored[key] = path
    return spark.read.parquet(_stored[key])


def bars(spark: SparkSession, root: str) -> DataFrame:
    """The bar table; see ``derived_bars``."""
    return stored(spark, root, "bars", derived_bars)


def derived_bars(spark: SparkSession, root: str) -> DataFrame:
    """Weekly bars whose prices are pulled towards the volume-weighted mean of ten weeks."""
    trail = Window.partitionBy("sym").orderBy("d").rowsBetween(-(SMOOTH_BARS - 1), 0)
    weekly = _weekly(spark, root).withColumn("s", F.sum("cents").over(trail)).withColumn("q", F.sum("qty").over(trail))
    pulled = {c: _ratio(f"9 * s + 100 * q * {c}", "1000 * q") for c in ("op", "hi", "lo", "cl")}
    return _as_bars(weekly.withColumns(pulled))


def universe(spark: SparkSession, root: str) -> DataFrame:
    """Symbol dimension; nation and region are fixed 25- and 5-row tables."""
    nation = table(spark, root, "nation").join(
        F.broadcast(table(spark, root, "region")), F.expr("n_regionkey = r_regionkey"))
    return table(spark, root, "supplier").join(F.broadcast(nation), F.expr("s_nationkey = n_nationkey")).select(
        F.col("s_suppkey").alias("sym"), F.col("s_name").alias("name"),
        F.col("n_name").alias("industry"), F.col("r_name").alias("region"),
        F.col("s_acctbal").alias("balance"),
    )


def market_daily(spark: SparkSession, root: str) -> DataFrame:
    """The market series; see ``derived_market``."""
    return stored(spark, root, "market", derived_market)


def derived_market(spark: SparkSession, root: str) -> DataFrame:
    """Market activity per date, in currency units (summed exactly in cents)."""
    return table(spark, root, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(
        (F.sum(F.rint(F.col("l_extendedprice") * 100).cast("bigint")) / 100.0).alias("amv"),
        F.count(F.lit(1)).alias("stock_count"),
    )


def index_daily(spark: SparkSession, root: str) -> DataFrame:
    """A market index per date: mean order value."""
    cents = F.sum(F.rint(F.col("o_totalprice") * 100).cast("bigint"))
    return table(spark, root, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(
        (cents / F.count(F.lit(1)) / 100.0).alias("close"))


def fundamentals(bars_df: DataFrame) -> DataFrame:
    """Market value and turnover per symbol and date, derived from bars."""
    return bars_df.select(
        "sym", "d",
        (F.col("close") * 1000).alias("circ_mv"), (F.col("close") * 1500).alias("total_mv"),
        (F.col("volume") % 17 + 1).alias("turnover_rate_f"),
        (F.col("close") * F.col("volume")).alias("amount"),
    )


AS_OF = "2024-01-31 00:00:00"


def users(spark: SparkSession, root: str) -> DataFrame:
    """Subscribers derived from customers: plan from the segment, expiry from the balance."""
    plan = (F.when(F.col("c_mktsegment") == "MACHINERY", "trial").when(F.col("c_mktsegment") == "BUILDING", "free")
            .when(F.col("c_mktsegment") == "AUTOMOBILE", "monthly").when(F.col("c_mktsegment") == "FURNITURE", "yearly")
            .otherwise("quarterly"))
    days = F.floor((F.col("c_acctbal") - 4000) / 100).cast("int")
    return table(spark, root, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("nickname"), plan.alias("plan"),
        (F.col("c_custkey") % 7 != 3).alias("is_subscribed"),
        F.when(plan != "free", F.date_add(F.lit(AS_OF[:10]).cast("date"), days)).alias("plan_expire"),
    )


def push_logs(spark: SparkSession, root: str) -> DataFrame:
    """Delivery log derived from events."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, root, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("push_time"),
        F.when(F.col("event_type").isin("click", "view"), "intraday").otherwise("after_hours").alias("mode"),
        k.alias("signal_count"), F.when(F.col("event_type") != "error", 1).otherwise(0).alias("success"),
        F.rint(F.col("value") * 100).cast("bigint").alias("duration_ms"), "user_id", "event_type",
    )
