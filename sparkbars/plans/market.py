"""Registered regime, grid and industry queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkbars.functions.windows import prior
from sparkbars.operators import industry, regime
from sparkbars.operators.indicators import indicators
from sparkbars.params import BEST, FINE_GRID, GRID, REGIME, V62, V63
from sparkbars.plans.features import feature_frame
from sparkbars.plans.ledgers import regime_settings
from sparkbars.sources import views

UP, LOW = REGIME["upper"], REGIME["lower"]


def _daily(spark, root):
    return regime.daily_state(views.market_daily(spark, root), **regime_settings())


def _weeks(spark, root):
    return regime.weekly_state(_daily(spark, root), UP, LOW, REGIME["weekly_span"])


def market_amv(spark, root, first=None, last=None):
    """Activity of each date from `first` to `last`; by default of all dates of the table."""
    bars = views.bars(spark, root).where("volume > 0 and close is not null")
    for bound, within in ((first, F.col("d") >= F.lit(first)), (last, F.col("d") <= F.lit(last))):
        bars = bars if bound is None else bars.where(within)
    return bars.groupBy("d").agg(F.round(F.sum(F.col("close") * F.col("volume")), 2).alias("amv"))


def market_amv_turnover(spark, root):
    f = views.fundamentals(views.bars(spark, root))
    amv = F.expr("try_cast(circ_mv as double) * try_cast(turnover_rate_f as double) / 100")
    return f.groupBy("d").agg(F.round(F.sum(amv), 2).alias("amv"), F.count(F.lit(1)).alias("stock_count"))


def amv_unit_repair(spark, root):
    scale = F.when(F.col("d") >= "2000-01-01", 0.1).when(F.col("d") >= "1998-01-01", 100.0).otherwise(1.0)
    series = views.market_daily(spark, root).select("d", (F.col("amv") * scale).alias("amv"))
    return regime.repair_units(series).select("d", F.round("repaired", 2).alias("amv"))


def _smoothed(method, n, digits=4):
    def make(spark, root):
        df = regime.smooth(views.market_daily(spark, root), "amv", "smoothed", method, n)
        return df.select("d", F.round("smoothed", digits).alias("smoothed"))
    return make


def regime_x(spark, root):
    df = regime.with_x(views.market_daily(spark, root), REGIME["smooth"], REGIME["cost"])
    return df.select("d", F.round("smoothed", 4).alias("smoothed"), F.round("cost_ma", 4).alias("cost_ma"), F.round("x", 6).alias("x"))


def regime_x_ema(spark, root):
    """Distance from an exponential cost average of the exponentially smoothed activity."""
    df = regime.with_x(views.market_daily(spark, root), 15, 42, "ema", cost_method="ema")
    return df.select("d", F.round("smoothed", 2).alias("smoothed"), F.round("cost_ma", 2).alias("cost_ma"), F.round("x", 5).alias("x"))


def amv_source_variants(spark, root):
    """Activity by the three source preferences: traded amount, total value, circulating value."""
    bars = views.bars(spark, root)
    f = views.fundamentals(bars).join(bars.select("sym", "d", "volume", "close"), ["sym", "d"])
    return f.groupBy("d").agg(
        F.round(F.sum(F.coalesce("amount", F.col("volume") * F.col("close"))), 2).alias("by_amount"),
        F.round(F.sum(F.col("total_mv") * F.col("turnover_rate_f") / 100), 2).alias("by_total_value"),
        F.round(F.sum(F.col("circ_mv") * F.col("turnover_rate_f") / 100), 2).alias("by_circulating"))


def amv_universe(spark, root):
    return views.bars(spark, root).groupBy("d").agg(F.round(F.sum(F.col("volume") * F.col("close")), 2).alias("amv"))


def amv_from_fundamentals(spark, root):
    """Inner alignment of bars and fundamentals on (symbol, date), zero where nothing matches."""
    bars = views.bars(spark, root)
    f = views.fundamentals(bars).where("turnover_rate_f > 3").select("sym", "d", (F.col("total_mv") * F.col("turnover_rate_f") / 100).alias("v"))
    return bars.select("sym", "d").join(f, ["sym", "d"], "left").groupBy("d").agg(F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 2).alias("amv"))


def regime_state_daily(spark, root):
    return _daily(spark, root).select("d", "state", F.round("x", 6).alias("x"))


def weekly_resample(spark, root):
    return regime.weekly(_daily(spark, root)).select("week", F.round("x", 6).alias("x"))


def regime_state_weekly(spark, root):
    return _weeks(spark, root).select(F.col("d").alias("week"), F.round("x", 6).alias("x"), "state")


def asof_weekly_state(spark, root):
    weeks = _weeks(spark, root).select("d", F.col("state").alias("weekly_state"))
    out = regime.asof_backward(_daily(spark, root).select("d"), weeks, "weekly_state")
    return out.select("d", F.coalesce("weekly_state", F.lit(1)).alias("weekly_state"))


def regime_allowed(spark, root):
    return regime.allowed(_daily(spark, root), _weeks(spark, root)).select("d", "allowed")


def regime_transitions(spark, root):
    return regime.transitions(_daily(spark, root)).withColumn("x", F.round("x", 6))


def regime_summary(spark, root):
    return regime.summary(_daily(spark, root), _weeks(spark, root), UP, LOW)


def _status(spark, root):
    return regime.status(regime.allowed(_daily(spark, root), _weeks(spark, root)))


def regime_status(spark, root):
    recent = F.array_join(F.transform("recent_states", lambda s: F.concat_ws(":", s["date"], s["state"])), "|")
    return _status(spark, root).select(
        "latest_date", "daily_allowed", "can_open_position", "latest_x", recent.alias("recent"),
        F.col("last_transition.date").alias("last_date"), F.col("last_transition.to_state").alias("last_state"), "trend_label")


def regime_changes(spark, root):
    """The status record from turnover instead of activity."""
    turnover = market_amv_turnover(spark, root).select("d", "amv")
    text = F.transform("changes", lambda s: F.concat_ws(":", F.date_format(s["d"], "MM-dd"), s["to"]))
    return regime.changes(regime.daily_state(turnover, **regime_settings())).select("can_open_position", F.array_join(text, "|").alias("changes"))


def regime_roc_latch(spark, root):
    return regime.roc_latch(views.market_daily(spark, root)).select("d", "allowed")


def _returns(spark, root):
    w = Window.orderBy("d")
    index = views.index_daily(spark, root).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    return views.market_daily(spark, root).join(index.select("d", "ret"), "d", "left")


def regime_eval(spark, root):
    """Timing quality of the production setting on its own."""
    df = _returns(spark, root)
    states = regime.daily_state(df, **regime_settings()).withColumn("setting", F.lit("production"))
    return regime.evaluate(states, ["setting"])


def _grid(spark, root, settings=GRID, strict=True, least=4):
    return regime.grid_evaluation(_returns(spark, root), settings, strict, least)


def regime_grid(spark, root):
    return _grid(spark, root)


def regime_grid_fine(spark, root):
    return _grid(spark, root, FINE_GRID, False, 3)


def regime_grid_topn(spark, root):
    """Best combinations by each measure, the balanced choice with its relaxed fallback, and the rank of the default."""
    full = _grid(spark, root)
    keys = ["smooth", "cost", "upper", "lower"]
    tie = [F.col(k) for k in keys]
    over = lambda order: F.row_number().over(Window.orderBy(order, *tie))
    strict = (F.col("excess_annual_pct") > 3) & (F.col("transitions") < 30) & F.col("bull_ratio_pct").between(40.0001, 79.9999)
    relaxed = (F.col("excess_annual_pct") > 1) & (F.col("transitions") < 40) & F.col("bull_ratio_pct").between(30.0001, 84.9999)
    ranked = full.withColumns({
        "by_strategy": over(F.desc("strategy_annual_pct")), "by_excess": over(F.desc("excess_annual_pct")),
        "by_avoid": over(F.asc("bear_annual_pct")), "_any": F.max(strict).over(Window.partitionBy())})
    pool = F.when(F.col("_any"), strict).otherwise(relaxed)
    balanced = F.when(pool, F.row_number().over(Window.partitionBy(pool).orderBy(F.desc("excess_annual_pct"), *tie)))
    current = (F.col("smooth") == 8) & (F.col("cost") == 21) & (F.col("upper") == 4.0) & (F.col("lower") == -2.3)
    ranked = ranked.withColumns({"balanced": balanced, "is_default": current})
    keep = "by_strategy <= 20 or by_excess <= 20 or by_avoid <= 10 or balanced <= 10 or is_default"
    return ranked.where(keep).select(*keys, "strategy_annual_pct", "excess_annual_pct", "bear_annual_pct", "by_strategy",
                                     "by_excess", "by_avoid", "balanced", "is_default")


def regime_grid_pivot(spark, root):
    """Heat map of the fine grid: rows are upper limits, columns lower limits."""
    fine = regime_grid_fine(spark, root)
    lows = FINE_GRID["lower"]
    named = fine.withColumn("col", F.concat(F.lit("low_"), F.round(-F.col("lower") * 10).cast("int").cast("string")))
    cols = [f"low_{int(-v * 10)}" for v in lows]
    return named.groupBy("upper").pivot("col", cols).agg(F.max("excess_annual_pct"))


# ---- industry -------------------------------------------------------------------------


def _momentum(spark, root, n=BEST.industry_days):
    return industry.momentum(views.bars(spark, root), views.universe(spark, root), n)


def join_industry(spark, root):
    """Quiet-volume bars per industry."""
    df = feature_frame(spark, root).where("no_supply").join(views.universe(spark, root), "sym").where("industry != ''")
    return df.groupBy("industry").agg(F.count(F.lit(1)).alias("bars"), F.round(F.avg("close"), 6).alias("avg_close"))


def industry_momentum(spark, root):
    return _momentum(spark, root).select("industry", "d", F.round("momentum", 6).alias("momentum"))


def industry_allow_abs(spark, root):
    return industry.allow_absolute(_momentum(spark, root, V62.industry_days), V62.industry_threshold)


def industry_rs_rank(spark, root):
    ranked = industry.percentile_rank(industry.densify(_momentum(spark, root)))
    return ranked.select("industry", "d", F.round("rs_rank", 6).alias("rs_rank"))


def industry_allow_rs(spark, root):
    return industry.allow_strength(_momentum(spark, root), V63.industry_top)


def _latest(spark, root):
    df = feature_frame(spark, root, BEST)
    return df.groupBy("sym").agg(F.max_by("signal_v64", "d").alias("is_signal"))


def industry_stats(spark, root):
    return industry.stats(_momentum(spark, root), _latest(spark, root), views.universe(spark, root), BEST.industry_threshold)


def industry_topn(spark, root):
    """Five leading and three trailing industries with the counts of each rotation class."""
    stats = industry_stats(spark, root)
    totals = {
        "hot": F.count_if(F.col("momentum") > 0), "cold": F.count_if(F.coalesce(F.col("momentum") <= 0, F.lit(False))),
        "rotated_in": F.count_if(F.col("rotation") == "轮入"), "rotated_out": F.count_if(F.col("rotation") == "轮出"),
        "faster": F.count_if(F.col("rotation") == "加速")}
    every = Window.partitionBy()
    ranked = stats.withColumns({
        "top": F.row_number().over(Window.orderBy(F.desc_nulls_last("momentum"), "industry")),
        "bottom": F.row_number().over(Window.orderBy(F.asc_nulls_last("momentum"), "industry")),
        **{n: v.over(every) for n, v in totals.items()}})
    return ranked.where("top <= 5 or bottom <= 3").select("industry", "momentum", "top", "bottom", *totals)


def industry_ma_lines(spark, root):
    lines = industry.ma_lines(indicators(views.bars(spark, root)), views.universe(spark, root))
    return lines.select("industry", "d", F.round("white", 4).alias("white"), F.round("yellow", 9).alias("yellow"))


def asof_nearest_momentum(spark, root):
    """Industry momentum nearest to each signal, at most one day away."""
    sig = feature_frame(spark, root).where("signal_v64").select("sym", "d").join(views.universe(spark, root).select("sym", "industry"), "sym")
    shifted = sig.withColumn("d", F.date_add("d", (F.col("sym") % 3 - 1).cast("int")))
    return industry.nearest(shifted, _momentum(spark, root), "momentum").select("sym", "d", "industry", F.round("momentum", 6).alias("momentum"))


def exact_median(df, keys, value, scale=1000):
    """Exact median per key without collecting a group.

    Counts per value bucket find the bucket holding the middle; only that bucket is ordered.
    """
    ranged = df.where(F.col(value).isNotNull()).withColumn("b", F.floor(F.col(value) * scale))
    hist = ranged.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    hist = hist.withColumns({"upto": F.sum("n").over(w.orderBy("b")), "total": F.sum("n").over(w)})
    lo, hi = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    hist = hist.withColumns({"lo": lo, "hi": hi, "start": F.col("upto") - F.col("n")})
    middle = hist.where((F.col("upto") >= F.col("lo")) & (F.col("start") < F.col("hi")))
    picked = ranged.join(middle.select(*keys, "b", "start", "lo", "hi"), [*keys, "b"])
    # Equal values share one row, so the ordered rows per bucket are distinct values only.
    counted = picked.groupBy(*keys, "b", "start", "lo", "hi", value).agg(F.count(F.lit(1)).alias("m"))
    end = F.col("start") + F.sum("m").over(Window.partitionBy(*keys, "b").orderBy(value))
    counted = counted.withColumn("end", end).withColumn("begin", F.col("end") - F.col("m"))

    def at(rank):
        return F.max(F.when((F.col("begin") < F.col(rank)) & (F.col("end") >= F.col(rank)), F.col(value)))

    return counted.groupBy(*keys).agg(((at("lo") + at("hi")) / 2).alias("median"))


def crash_guard(spark, root):
    """Median five-bar return of the market per date; a crash pauses trading for three dates."""
    df = indicators(views.bars(spark, root)).withColumn("ret5", F.col("close") / prior("close", 5) - 1)
    med = exact_median(df.select("d", "ret5"), ["d"], "ret5")
    hit = F.coalesce(F.col("median") < -0.05, F.lit(False))
    med = med.withColumn("crash", hit)
    pause = F.max("crash").over(Window.orderBy("d").rowsBetween(-2, 0))
    return med.select("d", F.round("median", 6).alias("median_ret5"), "crash", pause.alias("paused"))


def queries() -> dict:
    out = {f.__name__: f for f in (
        market_amv, market_amv_turnover, amv_unit_repair, regime_x, regime_x_ema, amv_source_variants, amv_universe, amv_from_fundamentals,
        regime_state_daily, weekly_resample, regime_state_weekly, asof_weekly_state, regime_allowed, regime_transitions,
        regime_summary, regime_status, regime_changes, regime_roc_latch, regime_eval, regime_grid, regime_grid_fine, regime_grid_topn,
        regime_grid_pivot, join_industry, industry_momentum, industry_allow_abs, industry_rs_rank, industry_allow_rs,
        industry_stats, industry_topn, industry_ma_lines, asof_nearest_momentum, crash_guard)}
    return out | {"amv_smooth_sma": _smoothed("sma", 15), "amv_smooth_hybrid": _smoothed("hybrid", 0), "amv_smooth_ema": _smoothed("ema", 15, 6),
                  "amv_smooth_ema_slow": _smoothed("ema", 42, 3), "amv_smooth_ema_one": _smoothed("ema", 1, 6)}
