"""Registered record, filter and daily-scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkbars.functions.windows import by_symbol, half_even, prior
from sparkbars.operators import industry, records, regime
from sparkbars.operators import universe as u
from sparkbars.operators.indicators import candles, indicators, neighbours, returns
from sparkbars.operators.signals import STEPS as SIGNAL_STEPS
from sparkbars.params import BEST, REGIME
from sparkbars.plans.features import feature_frame
from sparkbars.plans.ledgers import regime_settings
from sparkbars.plans.maintenance import _listing

from sparkbars.sources import views

c = F.col


def _context(spark, root):
    return records.with_context(feature_frame(spark, root, BEST), BEST)


def _signals(spark, root):
    return _context(spark, root).where("signal_v64")


def _permitted(spark, root):
    """Market permission per date; one row per calendar date, so it may be broadcast."""
    daily = regime.daily_state(views.market_daily(spark, root), **regime_settings())
    weeks = regime.weekly_state(daily, REGIME["upper"], REGIME["lower"], REGIME["weekly_span"])
    return regime.allowed(daily, weeks).select("d", c("allowed").alias("bull"))


def momentum(spark, root):
    """Industry momentum by date, derived once: it needs the returns of all symbols, a scan only a few of its rows."""
    return views.stored(spark, root, "momentum", lambda spark, root: industry.momentum(
        views.bars(spark, root), views.universe(spark, root), BEST.industry_days), ("lineitem", "supplier", "nation", "region"))


def gated(spark, root, df):
    """Signals with regime, industry permission and momentum verdict."""
    df = df.join(_permitted(spark, root), "d", "left").withColumn("bull", F.coalesce("bull", F.lit(False)))
    allowed = industry.allow_absolute(momentum(spark, root), BEST.industry_threshold).withColumnRenamed("allow", "industry_ok")
    df = df.join(views.universe(spark, root).select("sym", "name", "industry"), "sym", "left")
    df = df.join(allowed, ["industry", "d"], "left").withColumn("industry_ok", F.coalesce("industry_ok", F.lit(True)))
    return records.momentum_check(df, BEST)


def signal_change_volratio(spark, root):
    df = _context(spark, root)
    return df.select("sym", "d", F.round("change_pct", 6).alias("change_pct"), F.round("vol_ratio", 6).alias("vol_ratio"))


def sos_dates_list(spark, root):
    return _context(spark, root).select("sym", "d", F.array_join("sos_dates", ",").alias("sos_dates"))


def _labels(df):
    return df.select("sym", "d", *[F.array_join(n, ";").alias(n) for n in ("wyckoff", "vpa", "candle")],
                     F.round("support", 8).alias("support"), F.round("resistance", 8).alias("resistance"))


def signal_detail_labels(spark, root):
    return _labels(records.detail(_signals(spark, root), BEST))


def signal_detail_extended(spark, root):
    return _labels(records.detail(_signals(spark, root), BEST, extended=True))


def t_trading_advice(spark, root):
    df = records.intraday_advice(_signals(spark, root))
    return df.select("sym", "d", "t_mode", "t_slope", "t_buy", "t_sell", "t_risk", F.round("t_amplitude", 6).alias("t_amplitude"))


def signal_priority_tier(spark, root):
    return records.tier(_signals(spark, root)).select("sym", "d", "score", "priority", "stars")


def seasonal_flag(spark, root):
    return views.market_daily(spark, root).select("d", records.season(c("d")).alias("season"))


def signal_record(spark, root):
    df = records.tier(records.intraday_advice(records.detail(_signals(spark, root), BEST)))
    df = df.join(views.universe(spark, root).select("sym", "name", "industry"), "sym", "left")
    rounded = {"price": "close", "white_line": "white_line", "yellow_line": "yellow_line", "j": "j", "atr14": "atr14",
               "change_pct": "change_pct", "vol_ratio": "vol_ratio", "stock_ret_n": "ret_n"}
    return df.select(
        "sym", "name", "industry", "d", *[F.round(v, 4).alias(k) for k, v in rounded.items()],
        F.array_join("sos_dates", ",").alias("sos_dates"), "score", "eq_j", "eq_volume", "eq_candle", "eq_ma", "flow_score", "flow_ok",
        F.round(c("close") * 0.95, 4).alias("hard_stop"), F.round(c("close") - 3 * c("atr14"), 4).alias("chandelier_init"),
        "support_score", "factor_a", "factor_b", "factor_c", "factor_d", "t_mode", "priority")


def momentum_boost(spark, root):
    df = gated(spark, root, _signals(spark, root))
    return df.select("sym", "d", "bull", "momentum_ok", "momentum_tag", "score_before", "score")


def momentum_hard_filter(spark, root):
    return gated(spark, root, _signals(spark, root)).where("momentum_ok").select("sym", "d", "score")


def signal_revival(spark, root):
    df = gated(spark, root, _signals(spark, root))
    return df.where(records.survives(BEST, revival=True)).select("sym", "d", "score", "industry_ok", "momentum_ok")


def _final(df):
    """Gates plus the dynamic score filter on the rounded record values."""
    keep = records.dynamic_score(BEST, c("bull"), F.round("j", 1), c("score"), half_even(c("vol_ratio"), 2))
    return df.where(records.survives(BEST) & keep)


def dynamic_score_filter(spark, root):
    return _final(gated(spark, root, _signals(spark, root))).select("sym", "d", "bull", "score")


YEARS = 2  # of a period; its partition holds the period's bars and each symbol's last TAIL bars before it
TAIL = 64  # more bars than signals look back from a bar whose indicators are known


# What a block keeps: the bar, its place, and what signals need of its history. Candles, changes and values of the bars just
# before follow from these, and are added where a block is read.
STORED = """sym d open high low close volume rn blk volume_ma volume_ma10 low_before5 low10 low12 flow_high yellow_line white_line vwap obv
j macd_hist low_hist12 atr14 atr30 max_return30 low_obv10""".split()


def _period(day):
    return F.floor(F.year(day) / YEARS)


def indicator_blocks(spark, root):
    """Bars with their indicators, recurrences included, by period: what a scan of one day reads is one period long, not the history."""
    return views.stored(spark, root, "indicator-blocks", _derived_blocks, by=("period",))


def _derived_blocks(spark, root):
    rows = indicators(views.bars(spark, root)).select(*STORED, _period("d").alias("period"))
    ends = rows.groupBy("sym", "period").agg(F.max("rn").alias("last"))
    ends = ends.groupBy("sym").agg(F.collect_list(F.struct("period", "last")).alias("ends"))  # one entry a period
    newest = rows.agg(F.max("period")).first()[0] or 0
    before = lambda p: F.array_max(F.transform(F.filter("ends", lambda e: e["period"] < p), lambda e: e["last"]))
    later = F.when(c("period") < newest, F.sequence(c("period") + 1, F.lit(newest).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    tails = F.filter(later, lambda p: before(p) - c("rn") < TAIL)
    rows = rows.join(ends, "sym")
    return rows.withColumn("period", F.explode(F.concat(F.array("period"), tails))).drop("ends")


def _block_of(spark, root, day):
    """The stored rows that decide signals up to a day: a partition, and of it the dates up to the day."""
    rows = indicator_blocks(spark, root)
    newest = rows.agg(F.max("period")).first()[0]  # from the names of partitions
    rows = rows.where((c("period") == F.least(F.lit(newest), _period(F.lit(day).cast("date")))) & (c("d") <= F.lit(day).cast("date"))).drop("period")
    rows = candles(rows)
    return rows.withColumns({name: prior(source, n) for name, (source, n) in neighbours().items()}).withColumns(returns())


def scan_of_day(spark, root, day):
    """The whole scan as of a date: eligible universe, signal on each symbol's newest bar, gates, labels, tier."""
    return scan_of_days(spark, root, day, day).drop("as_of")


def scan_of_days(spark, root, first, last):
    """The scan as of every date with bars from ``first`` to ``last`` of one period; ``as_of`` is the date of the scan."""
    eligible = u.tradable(_listing(spark, root)).select("sym")
    rows = _block_of(spark, root, last)
    df = rows
    for step in SIGNAL_STEPS:
        df = step(df, BEST)
    following = F.lead("d").over(by_symbol())
    df = records.with_context(df, BEST).withColumn("following", following).where("signal_v64").join(eligible, "sym", "left_semi")
    start, end = (F.lit(x).cast("date") for x in (first, last))
    if first == last:
        df = df.where("following is null").withColumn("as_of", end)
    else:
        days = [r.d for r in rows.where(c("d") >= start).select("d").distinct().collect()]  # calendar days of a period
        held = F.filter(F.array(*(F.lit(x) for x in sorted(days))).cast("array<date>"), lambda x: (x >= c("d")) & (c("following").isNull() | (x < c("following"))))
        df = df.withColumn("as_of", F.explode(held))
    df = records.tier(records.detail(_final(gated(spark, root, df)), BEST))
    return df.select("as_of", "sym", "name", "industry", "d", F.round("close", 4).alias("price"), "score", "momentum_tag", "priority", "stars",
                     F.array_join("wyckoff", ";").alias("wyckoff"))


SCAN_DAY = "1996-08-05"
SCAN_DAYS = "1996-01-01", "1997-12-29"


def daily_scan(spark, root):
    return scan_of_day(spark, root, SCAN_DAY)


def daily_scans(spark, root):
    """One scan for each date with bars of two years."""
    return scan_of_days(spark, root, *SCAN_DAYS)


def scan_all_dates(spark, root):
    """The scan's gates and labels applied to every signal of the history."""
    df = records.tier(records.detail(_final(gated(spark, root, _signals(spark, root))), BEST))
    return df.select("sym", "name", "industry", "d", F.round("close", 4).alias("price"), "score", "momentum_tag", "priority", "stars",
                     F.array_join("wyckoff", ";").alias("wyckoff"))


def queries() -> dict:
    return {f.__name__: f for f in (
        signal_change_volratio, sos_dates_list, signal_detail_labels, signal_detail_extended, t_trading_advice, signal_priority_tier, seasonal_flag,
        signal_record, momentum_boost, momentum_hard_filter, signal_revival, dynamic_score_filter, daily_scan, daily_scans, scan_all_dates)}


