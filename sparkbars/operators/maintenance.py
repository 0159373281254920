"""Cleaning and incremental maintenance of a bar table.

Latest-row and last-source-wins rules use ``max_by`` aggregates rather than row_number
windows: they combine map-side, so a symbol with very many rows or duplicates is never
sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OHLC = ["open", "high", "low", "close"]
COLUMNS = ["sym", "d", *OHLC, "volume"]


def by_day():
    return Window.partitionBy("sym").orderBy("d")


def rename_columns(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Lower-case bar columns and map vendor aliases; the first alias present wins."""
    mapping = {c: c.lower() for c in df.columns if c.lower() in (*OHLC, "volume") and c != c.lower()}
    for target, names in (aliases or {}).items():
        source = next((n for n in names if n in df.columns), None)
        if source and source != target:
            mapping[source] = target
    return df.withColumnsRenamed(mapping)


def is_complete(df: DataFrame) -> bool:
    return all(c in df.columns for c in (*OHLC, "volume"))


def drop_bad(df: DataFrame) -> DataFrame:
    keep = F.col("volume") > 0
    for c in OHLC:
        keep = keep & F.col(c).isNotNull() & (F.col(c) > 0)
    return df.where(keep)


def drop_jumps(df: DataFrame, limit: float = 0.5, most: int = 3) -> DataFrame:
    """Drop jump rows of symbols that have only a few; symbols with many keep them all."""
    change = F.col("close") / F.lag("close").over(by_day()) - 1
    df = df.withColumn("_jump", F.coalesce(F.abs(change) > limit, F.lit(False)))
    df = df.withColumn("_jumps", F.count_if("_jump").over(Window.partitionBy("sym")))
    return df.where(~F.col("_jump") | (F.col("_jumps") > most)).drop("_jump", "_jumps")


def fill_forward(df: DataFrame) -> DataFrame:
    w = by_day().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in (*OHLC, "volume")}).dropna(subset=[*OHLC, "volume"])


def clean(df: DataFrame) -> DataFrame:
    """All cleaning steps; a frame that lacks a bar column gives no rows instead of an error."""
    df = rename_columns(df)
    return fill_forward(drop_jumps(drop_bad(df))) if is_complete(df) else df.limit(0)


def min_history(df: DataFrame, rows: int) -> DataFrame:
    """Bars of symbols with enough rows: counted map-side, then a semi join."""
    enough = df.groupBy("sym").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rows).select("sym")
    return df.join(enough, "sym", "left_semi")


def scan_symbol(df: DataFrame, sym, min_rows: int = 10) -> DataFrame:
    """Ordered bars of one symbol, none if it has too few; the key filter reaches the scan."""
    return min_history(df.where(F.col("sym") == sym), min_rows)


def latest_dates(df: DataFrame) -> DataFrame:
    return df.groupBy("sym").agg(F.max("d").alias("latest"))


def latest_rows(df: DataFrame) -> DataFrame:
    return df.groupBy("sym").agg(F.max("d").alias("d"), F.max_by("close", "d").alias("close"))


def stale(df: DataFrame, target: Column, full: bool = False) -> DataFrame:
    latest = latest_dates(df)
    return latest if full else latest.where(F.col("latest") < target)


def backfill_dates(df: DataFrame, target: Column) -> DataFrame:
    """Weekdays after the earliest latest date up to the target; the target alone if there are none."""
    one = latest_dates(df).agg(F.min("latest").alias("first")).withColumn("target", target)
    start = F.date_add("first", 1)
    days = F.when(start <= F.col("target"), F.sequence(start, F.col("target"))).otherwise(F.array().cast("array<date>"))
    days = F.filter(days, lambda x: F.weekday(x) < 5)
    return one.select(F.explode(F.when(F.size(days) == 0, F.array("target")).otherwise(days)).alias("d"))


def merge_last(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union with the newer source winning on (sym, d)."""
    rows = old.select(*COLUMNS, F.lit(0).alias("src")).unionByName(new.select(*COLUMNS, F.lit(1).alias("src")))
    picks = [F.max_by(c, "src").alias(c) for c in (*OHLC, "volume")]
    return rows.groupBy("sym", "d").agg(*picks)


def append_newer(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` later than what the symbol already has."""
    return new.join(latest_dates(old), "sym", "left").where("latest is null or d > latest").drop("latest")


def adjustment_check(old: DataFrame, new: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Does the overlap day agree? No overlap, or a cached zero, counts as consistent."""
    cached = latest_rows(old).withColumnRenamed("close", "cached")
    overlap = new.groupBy("sym", "d").agg(F.max("close").alias("fresh"))
    off = F.abs(F.col("cached") - F.col("fresh")) / F.nullif("cached", F.lit(0.0)) > tolerance
    return cached.join(overlap, ["sym", "d"], "left").select("sym", "d", (~F.coalesce(off, F.lit(False))).alias("consistent"))


def history_gaps(df: DataFrame, start: Column, slack: int = 5) -> DataFrame:
    first = df.groupBy("sym").agg(F.min("d").alias("first"))
    return first.where(F.col("first") > F.date_add(start, slack)).select(
        "sym", start.alias("fill_from"), F.date_sub("first", 1).alias("fill_to"))


def merge_day(table: DataFrame, day: DataFrame) -> DataFrame:
    """Raw bars of one day mapped into adjusted prices: ratio = last adjusted close / raw previous close.

    Unknown symbols keep raw prices; a previous close of zero or less skips the symbol.
    """
    last = latest_rows(table).select("sym", F.col("d").alias("latest"), F.col("close").alias("adjusted"))
    rows = day.join(last, "sym", "left").where("latest is null or latest < d")
    rows = rows.where("adjusted is null or pre_close > 0")
    ratio = F.when(F.col("adjusted").isNull(), F.lit(1.0)).otherwise(F.col("adjusted") / F.nullif("pre_close", F.lit(0.0)))
    return rows.select("sym", "d", *[(F.col(c) * ratio).alias(c) for c in OHLC], "volume")


def forward_adjust(raw: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices scaled by the last known factor / the latest factor; raw prices where no factor is known yet, or ever.

    Factors are merged into the bars and carried forward, so their dates need not be those of bars.
    """
    rows = raw.select(*COLUMNS, F.lit(1).alias("_bar")).unionByName(
        factors.select("sym", "d", "adj_factor", F.lit(0).alias("_bar")), allowMissingColumns=True)
    so_far = Window.partitionBy("sym").orderBy("d", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.partitionBy("sym").orderBy("d", "_bar").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ratio = F.coalesce(F.last("adj_factor", True).over(so_far) / F.last("adj_factor", True).over(all_rows), F.lit(1.0))
    return rows.withColumn("_ratio", ratio).where("_bar = 1").select("sym", "d", *[(F.col(c) * F.col("_ratio")).alias(c) for c in OHLC], "volume")


def quote_ratio(quotes: DataFrame, history: DataFrame) -> DataFrame:
    """Quotes with the ratio from raw to adjusted prices, taken from the last close before the quote's own date.

    One pass over history and quotes together; within a date quotes come first, so they never see that date's bar.
    """
    rows = quotes.withColumn("_bar", F.lit(0)).unionByName(
        history.select("sym", "d", F.col("close").alias("_close"), F.lit(1).alias("_bar")), allowMissingColumns=True)
    before = Window.partitionBy("sym").orderBy("d", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("reference", F.last("_close", True).over(before)).where("_bar = 0").drop("_bar", "_close")
    ratio = F.when((F.col("pre_close") > 0) & (F.col("reference") > 0), F.col("reference") / F.col("pre_close"))
    return rows.withColumn("ratio", F.coalesce(ratio, F.lit(1.0)))


def splice_quotes(history: DataFrame, quotes: DataFrame) -> DataFrame:
    """Today's bar from live quotes appended to, or written over, the history."""
    live = quote_ratio(quotes.where("close > 0"), history).select(
        "sym", "d", *[(F.col(c) * F.col("ratio")).alias(c) for c in OHLC], "volume")
    return merge_last(history, live)


def retention(df: DataFrame, days: int) -> DataFrame:
    """Last ``days`` days counted from the newest date; 0 keeps everything."""
    if days == 0:
        return df
    return df.where(F.col("d") >= F.date_sub(df.agg(F.max("d")).scalar(), days))


def calendar(span: DataFrame, overrides: DataFrame) -> DataFrame:
    """Trading flag per date of ``span(first, last)``; listed exceptions beat the weekend rule."""
    days = span.select(F.explode(F.sequence("first", "last")).alias("d"))
    return days.join(overrides, "d", "left").select(
        "d", F.coalesce("is_open", F.weekday("d") < 5).alias("is_open"))
