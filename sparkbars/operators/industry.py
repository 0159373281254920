"""Cross-sectional industry analytics, in long form (one row per date and industry).

Symbols are first folded to (industry, date) with partial aggregation; everything after that
works on the small industry x calendar table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEMBERS = 3


def by_industry():
    return Window.partitionBy("industry").orderBy("d")


def _members(joined: DataFrame, least: int) -> DataFrame:
    """Industries with at least ``least`` symbols. Distinct pairs first, so no industry is one hot group."""
    pairs = joined.select("industry", "sym").distinct()
    return pairs.groupBy("industry").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)


def momentum(bars: DataFrame, universe: DataFrame, n: int, least: int = MEMBERS) -> DataFrame:
    """Rolling sum of the equal-weight mean return per industry, null while it is too short."""
    change = F.col("close") / F.lag("close").over(Window.partitionBy("sym").orderBy("d")) - 1
    classed = universe.where("industry is not null and industry != ''").select("sym", "industry")
    rows = bars.select("sym", "d", change.alias("change")).join(classed, "sym")
    listed = bars.select("sym").distinct().join(classed, "sym")  # needs no returns, so the window runs once
    per_day = rows.groupBy("industry", "d").agg(F.avg("change").alias("change"))
    per_day = per_day.join(_members(listed, least).select("industry"), "industry")
    frame = by_industry().rowsBetween(-(n - 1), 0)
    enough = F.count("change").over(frame) >= max(n // 2, 5)
    return per_day.select("industry", "d", F.when(enough, F.sum("change").over(frame)).alias("momentum"))


def densify(df: DataFrame) -> DataFrame:
    """Add the missing (industry, date) cells: every industry gets one row per known date."""
    axes = df.agg(F.collect_set("industry").alias("names"), F.collect_set("d").alias("dates"))  # two bounded dimensions
    cells = axes.select(F.explode("names").alias("industry"), "dates").select("industry", F.explode("dates").alias("d"))
    return cells.join(df, ["industry", "d"], "left")


def allow_absolute(df: DataFrame, threshold: float) -> DataFrame:
    return densify(df).select("industry", "d", F.coalesce(F.col("momentum") > threshold, F.lit(False)).alias("allow"))


def percentile_rank(df: DataFrame) -> DataFrame:
    """Average rank divided by the number of values per date; null momentum keeps a null rank."""
    present = F.col("momentum").isNotNull()
    day = Window.partitionBy("d", present)
    ties = F.count(F.lit(1)).over(Window.partitionBy("d", present, "momentum"))
    rank = F.rank().over(day.orderBy("momentum"))
    pct = (rank + (ties - 1) / 2.0) / F.count(F.lit(1)).over(day)
    return df.withColumn("rs_rank", F.when(present, pct))


def allow_strength(df: DataFrame, top: float, rotation: bool = True, lag: int = 5) -> DataFrame:
    """Top share by rank, or accelerating while above the middle."""
    ranked = percentile_rank(densify(df))
    change = F.col("momentum") - F.lag("momentum", lag).over(by_industry())
    allow = F.coalesce(F.col("rs_rank") >= 1.0 - top, F.lit(False))
    if rotation:
        allow = allow | F.coalesce((change > 0) & (F.col("rs_rank") > 0.5), F.lit(False))
    return ranked.select("industry", "d", allow.alias("allow"))


def stats(df: DataFrame, latest_signals: DataFrame, universe: DataFrame, threshold: float) -> DataFrame:
    """Momentum now and five dates ago, heat and rotation labels, signal and stock counts."""
    dense = densify(df)
    order = Window.partitionBy("industry").orderBy(F.desc("d"))
    placed = dense.withColumn("back", F.row_number().over(order))
    now = placed.groupBy("industry").agg(
        F.max(F.when(F.col("back") == 1, F.col("momentum"))).alias("m"),
        F.max(F.when(F.col("back") == 6, F.col("momentum"))).alias("p"), F.max("back").alias("dates"))
    counts = universe.join(latest_signals, "sym").groupBy("industry").agg(
        F.count(F.lit(1)).alias("stock_count"), F.count_if("is_signal").alias("signal_count"))
    m, step = F.col("m"), F.col("m") - F.col("p")
    hot = F.coalesce(m > threshold, F.lit(False))
    was = F.coalesce(F.col("p") > threshold, F.lit(False))
    # Heat labels from hot to icy, rotation labels in, out, faster, slower, recovering, worse, steady.
    heat = (F.when(m > 0.05, "火热").when(m > 0.02, "偏热").when(m > 0, "微热").when(m > -0.02, "微冷")
            .when(m > -0.05, "偏冷").otherwise("冰冷"))
    rotation = (F.when(~was & hot, "轮入").when(was & ~hot, "轮出").when(hot & (step > 0.01), "加速")
                .when(hot & (step < -0.01), "减速").when(~hot & (step > 0.01), "回暖")
                .when(~hot & (step < -0.01), "恶化").otherwise("平稳"))
    return now.where("dates >= 6").join(counts, "industry", "left").select(
        "industry", F.round(m * 100, 4).alias("momentum"), F.round(step * 100, 4).alias("momentum_change"),
        rotation.alias("rotation"), heat.alias("hot_cold"), F.coalesce("signal_count", F.lit(0)).alias("signal_count"),
        F.coalesce("stock_count", F.lit(0)).alias("stock_count"))


def ma_lines(features: DataFrame, universe: DataFrame, least: int = MEMBERS) -> DataFrame:
    """Mean fast and slow lines of an industry's members."""
    rows = features.select("sym", "d", "white_line", "yellow_line").join(
        universe.where("industry != ''").select("sym", "industry"), "sym")
    lines = rows.groupBy("industry", "d").agg(F.avg("white_line").alias("white"), F.avg("yellow_line").alias("yellow"))
    return lines.join(_members(rows, least).select("industry"), "industry")


def nearest(left: DataFrame, right: DataFrame, value: str, days: int = 1) -> DataFrame:
    """Nearest right row per (industry, date) within ``days``; the earlier date wins a tie.

    The tolerance is a fixed small number of days, so the right side is repeated once per
    offset and matched with an equi-join instead of a range join.
    """
    offsets = F.array(*[F.lit(k) for k in range(-days, days + 1)])
    near = right.select("industry", F.col("d").alias("found"), F.explode(offsets).alias("off"), value)
    near = near.select("industry", F.date_add("found", F.col("off")).alias("d"), F.struct(
        F.abs("off").alias("gap"), "found", F.col(value).alias("v")).alias("hit"))
    best = near.groupBy("industry", "d").agg(F.min("hit").alias("hit"))
    return left.join(best, ["industry", "d"], "left").withColumn(value, F.col("hit.v")).drop("hit")
