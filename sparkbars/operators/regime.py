"""Market regime: smoothing, hysteresis latch, weekly state and its evaluation.

A market series has one row per date, so its single-partition windows are bounded by the
calendar. ``keys`` names the columns that separate several series (parameter grids, symbols).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbars.functions.recurrences import ewm, span
from sparkbars.functions.windows import BLOCK

DAYS = 252  # trading days per year


def by_date(keys: list[str] | None = None):
    return Window.partitionBy(*(keys or [])).orderBy("d")


def up_to_now(keys: list[str] | None = None):
    return by_date(keys).rowsBetween(Window.unboundedPreceding, 0)


def full_mean(column: str, n: int, keys: list[str] | None = None) -> Column:
    """Mean of the last n rows, null until n values are there."""
    frame = by_date(keys).rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(frame) >= n, F.avg(column).over(frame))


def numbered(df: DataFrame, keys: list[str] | None = None, column: str | None = None) -> DataFrame:
    """Rows numbered by date; with a column, from its first value on, 0 before and where it is null."""
    rn = F.row_number().over(by_date(keys))
    if column:
        rn = F.when(F.col(column).isNotNull(), F.count(column).over(up_to_now(keys))).otherwise(0)
    return df.withColumn("rn", rn).withColumn("blk", F.floor((F.col("rn") - 1) / BLOCK).cast("int"))


def smooth(df: DataFrame, column: str, out: str, method: str, n: int = 8, keys: list[str] | None = None) -> DataFrame:
    if method == "sma":
        return df.withColumn(out, full_mean(column, n, keys))
    if method == "hybrid":
        return df.withColumn(out, 0.6 * full_mean(column, 5, keys) + 0.4 * full_mean(column, 20, keys))
    if method == "none":
        return df.withColumn(out, F.col(column))
    if method == "ema":
        return ewm(numbered(df, keys, column), keys or [], {out: (column, span(n))}).drop("rn", "blk")
    raise ValueError(f"unknown smoothing method: {method}")


def with_x(df: DataFrame, n: int, cost: int, method: str = "sma", column: str = "amv", cost_method: str = "sma") -> DataFrame:
    """Distance of smoothed activity from its own cost average, in percent."""
    df = smooth(df, column, "smoothed", method, n)
    df = smooth(df, "smoothed", "cost_ma", cost_method, cost)
    return df.withColumn("x", (F.col("smoothed") - F.col("cost_ma")) / F.col("cost_ma") * 100.0)


def latch(on: Column, off: Column, window) -> Column:
    """Hysteresis: the last event wins, undecided rows hold the state, the start is 0."""
    event = F.when(on, 1).when(off, 0)
    return F.coalesce(F.last(event, ignorenulls=True).over(window), F.lit(0))


def with_state(df: DataFrame, upper: float, lower: float) -> DataFrame:
    return df.withColumn("state", latch(F.col("x") >= upper, F.col("x") <= lower, up_to_now()))


def daily_state(series: DataFrame, smooth: int, cost: int, upper: float, lower: float) -> DataFrame:
    return with_state(with_x(series, smooth, cost), upper, lower)


def weekly(df: DataFrame) -> DataFrame:
    """Last known x of each week; weeks end on Friday."""
    label = F.next_day(F.date_sub("d", 1), "FRI")
    return df.where("x is not null").groupBy(label.alias("week")).agg(F.max_by("x", "d").alias("x"))


def weekly_state(df: DataFrame, upper: float, lower: float, weekly_span: int = 5) -> DataFrame:
    """Weekly latch; a rising value above its average switches on inside the dead zone too."""
    w = weekly(df).withColumnRenamed("week", "d")
    w = smooth(w, "x", "mean_x", "ema", weekly_span)
    rising = (F.col("x") > F.col("mean_x")) & (F.col("x") > F.lag("x").over(by_date()))
    on = (F.col("x") >= upper) | ((F.col("x") > lower) & F.coalesce(rising, F.lit(False)))
    return w.withColumn("state", latch(on, F.col("x") <= lower, up_to_now()))


def asof_backward(left: DataFrame, right: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Latest ``right`` value at or before each left date: union and carry forward, no range join."""
    keys = keys or []
    rows = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(*keys, "d", value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("_side") == 0, F.col(value)), ignorenulls=True).over(order)
    return rows.withColumn(value, carried).where("_side = 1").drop("_side")


def allowed(daily: DataFrame, weeks: DataFrame) -> DataFrame:
    """Trading allowed: daily state on and the week's state, if any, on."""
    joined = asof_backward(daily, weeks.select("d", F.col("state").alias("weekly_state")), "weekly_state")
    joined = joined.withColumn("weekly_state", F.coalesce("weekly_state", F.lit(1)))
    return joined.withColumn("allowed", (F.col("state") == 1) & (F.col("weekly_state") == 1))


def transitions(daily: DataFrame) -> DataFrame:
    before = F.lag("state", 1, 0).over(by_date())
    return daily.withColumn("from_state", before).where("state != from_state").select(
        "d", "from_state", F.col("state").alias("to_state"), "x")


def repair_units(series: DataFrame, column: str = "amv", jump: float = 10.0) -> DataFrame:
    """Rescale everything after a day-over-day jump so that the jump vanishes.

    Scaling does not change later ratios, so the correction is a running product.
    """
    before = F.lag(column).over(by_date())
    ratio = F.when((before > 0) & (F.col(column) > 0), F.col(column) / before)
    scale = F.when((ratio > jump) | (ratio < 1.0 / jump), -F.ln(ratio)).otherwise(0.0)
    df = series.withColumn("_s", scale)
    total = F.exp(F.sum("_s").over(up_to_now()))
    few = F.count(F.lit(1)).over(Window.partitionBy()) < 3
    return df.withColumn("repaired", F.when(few, F.col(column)).otherwise(F.col(column) * total)).drop("_s")


def roc_latch(series: DataFrame, buy: float = 0.0425, sell: float = 0.0125) -> DataFrame:
    """Latch on the one-day change of activity."""
    roc = F.col("amv") / F.lag("amv").over(by_date()) - 1
    df = series.withColumn("roc", roc)
    return df.withColumn("allowed", latch(F.col("roc") >= buy, F.col("roc") <= -sell, up_to_now()) == 1)


def summary(daily: DataFrame, weeks: DataFrame, upper: float, lower: float) -> DataFrame:
    before = F.lag("state", 1, 0).over(by_date())
    x = F.col("x")
    day = daily.withColumn("_flip", (F.col("state") != before).cast("int")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == 1).alias("bull"),
        F.count_if(F.col("state") == 0).alias("bear"), F.count_if((x > lower) & (x < upper)).alias("buffer"),
        F.round(F.count_if(F.col("state") == 1) / F.count(F.lit(1)) * 100, 4).alias("bull_pct"),
        F.round(F.count_if((x > lower) & (x < upper)) / F.count("x") * 100, 4).alias("buffer_pct"),
        F.sum("_flip").alias("transitions"), F.round(F.min("x"), 6).alias("min_x"), F.round(F.max("x"), 6).alias("max_x"))
    return day.withColumns({"weeks": weeks.agg(F.count(F.lit(1))).scalar(),
                            "weeks_bull": weeks.agg(F.count_if(F.col("state") == 1)).scalar()})


def status(permitted: DataFrame) -> DataFrame:
    """One record for the latest date: permissions, last five states, last transition, trend label."""
    flips = permitted.withColumn("before", F.lag("state", 1, 0).over(by_date())).withColumns({
        "day": F.struct("d", "state", "x", "allowed"),
        "flip": F.when(F.col("state") != F.col("before"), F.struct("d", "state"))})
    newest = F.row_number().over(Window.orderBy(F.desc("d")))
    # State and trend labels.
    label = lambda s: F.when(s == 1, "允许").otherwise("禁止")
    out = flips.withColumn("newest", newest).agg(
        F.max("day").alias("last"), F.max("flip").alias("flip"),
        F.sort_array(F.collect_list(F.when(F.col("newest") <= 5, F.struct("d", "state", "x"))), asc=False).alias("recent"))
    recent = F.transform("recent", lambda s: F.struct(F.date_format(s["d"], "MM-dd").alias("date"), label(s["state"]).alias("state"),
                                                      F.round(s["x"], 2).alias("x")))
    return out.select(
        F.col("last.d").alias("latest_date"), (F.col("last.state") == 1).alias("daily_allowed"),
        F.col("last.allowed").alias("can_open_position"), F.round("last.x", 4).alias("latest_x"),
        recent.alias("recent_states"),
        F.struct(F.col("flip.d").alias("date"), label(F.col("flip.state")).alias("to_state")).alias("last_transition"),
        F.when(F.col("last.state") == 1, "活跃上升").otherwise("萎缩下降").alias("trend_label"))


def changes(daily: DataFrame, n: int = 3) -> DataFrame:
    """One record: may positions be opened, and the last n changes of state, oldest first."""
    flips = daily.withColumn("before", F.lag("state").over(by_date())).where("state <> before").orderBy(F.desc("d")).limit(n)
    # State labels.
    label = F.when(F.col("state") == 1, "牛市").otherwise("熊市")
    last = flips.agg(F.sort_array(F.collect_list(F.struct("d", label.alias("to")))).alias("changes"))
    return last.withColumn("can_open_position", daily.agg(F.max_by("state", "d") == 1).scalar())


def grid(settings: dict, strict: bool = True) -> list[tuple[float, float]]:
    """Admissible (upper, lower) pairs."""
    share = 1.0 if strict else 0.5
    return [(u, low) for u in settings["upper"] for low in settings["lower"] if u > abs(low) * share]


def grid_series(series: DataFrame, settings: dict) -> DataFrame:
    """One x series per (smooth, cost) pair as rows: six smoothed columns, then all cost averages."""
    df = series.select("d", "amv", "ret")
    df = df.withColumns({f"s{n}": full_mean("amv", n) for n in settings["smooth"]})
    df = df.withColumns({f"c{n}_{m}": full_mean(f"s{n}", m) for n in settings["smooth"] for m in settings["cost"]})
    pairs = [F.struct(F.lit(i).alias("pair"), F.lit(n).alias("smooth"), F.lit(m).alias("cost"),
                      ((F.col(f"s{n}") - F.col(f"c{n}_{m}")) / F.col(f"c{n}_{m}") * 100.0).alias("x"))
             for i, (n, m) in enumerate((n, m) for n in settings["smooth"] for m in settings["cost"])]
    return df.select("d", "ret", F.inline(F.array(*pairs)))


BITS = 60  # combinations whose states share one number


def grid_segments(series: DataFrame, settings: dict, strict: bool = True) -> DataFrame:
    """Runs of days with a return in which no combination of limits changes its state, with what a run adds to any of them.

    A combination is on while its upper limit was reached later than its lower one, so one running maximum of row numbers a
    limit decides all pairs of limits; their states are bits of ``states``. Rows: one a run, as many as the series' crossings.
    """
    limits = grid(settings, strict)
    pairs = len(settings["smooth"]) * len(settings["cost"])
    rows = grid_series(series, settings).repartition(pairs, "pair")
    place = F.row_number().over(by_date(["pair"]))
    reached = {f"on{k}": F.col("x") >= float(u) for k, u in enumerate(settings["upper"])} | {
        f"off{k}": F.col("x") <= float(low) for k, low in enumerate(settings["lower"])}
    rows = rows.withColumn("_n", place).withColumns({
        c: F.coalesce(F.max(F.when(hit, F.col("_n"))).over(up_to_now(["pair"])), F.lit(0)) for c, hit in reached.items()})
    is_on = [F.col(f"on{settings['upper'].index(u)}") > F.col(f"off{settings['lower'].index(low)}") for u, low in limits]
    words = [sum((F.shiftleft(on.cast("bigint"), k) for k, on in enumerate(is_on[start:start + BITS])), F.lit(0).cast("bigint"))
             for start in range(0, len(is_on), BITS)]
    rows = rows.where("ret is not null").select("pair", "smooth", "cost", "d", "ret", F.array(*words).alias("states"), F.log1p("ret").alias("g"))
    fresh = F.coalesce(F.lag("states").over(by_date(["pair"])) != F.col("states"), F.lit(True))
    rows = rows.withColumn("_fresh", fresh.cast("int")).withColumn("seg", F.sum("_fresh").over(up_to_now(["pair"])))
    inside = up_to_now(["pair", "seg"])
    rows = rows.withColumn("p", F.sum("g").over(inside)).withColumn("drop", F.col("p") - F.max("p").over(inside))
    return rows.groupBy("pair", "seg", "smooth", "cost").agg(
        F.min("states").alias("states"), F.count(F.lit(1)).alias("days"), F.count_if(F.col("ret") > 0).alias("wins"), F.sum("g").alias("grown"),
        F.min("p").alias("low"), F.max("p").alias("high"), F.min("drop").alias("drop"))


def grid_evaluation(series: DataFrame, settings: dict, strict: bool = True, min_transitions: int = 4) -> DataFrame:
    """``evaluate`` of every admissible combination, from the runs of its series instead of its days."""
    limits = F.array(*[F.struct(F.lit(i).alias("limit"), F.lit(float(u)).alias("upper"), F.lit(float(low)).alias("lower"))
                       for i, (u, low) in enumerate(grid(settings, strict))])
    runs = grid_segments(series, settings, strict).select("*", F.inline(limits))
    bit = F.expr(f"(shiftright(states[cast(limit div {BITS} as int)], limit % {BITS}) & 1) = 1")
    runs = runs.withColumn("bull", bit).withColumn("gain", F.when(F.col("bull"), F.col("grown")).otherwise(0.0))
    order = Window.partitionBy("pair", "limit").orderBy("seg")
    runs = runs.withColumns({
        "flip": F.coalesce((F.col("bull") != F.lag("bull").over(order)).cast("int"), F.lit(0)),
        "start": F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("gain")})
    runs = runs.withColumn("top", F.when(F.col("bull"), F.col("start") + F.col("high")).otherwise(F.col("start")))
    runs = runs.withColumn("peak", F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fall = F.when(F.col("bull"), F.least(F.col("start") + F.col("low") - F.col("peak"), F.col("drop"))).otherwise(
        F.col("start") - F.greatest("peak", "start"))
    of = lambda on, value: F.sum(F.when(F.col("bull") == on, value).otherwise(F.lit(0)))
    out = runs.groupBy("pair", "limit", "smooth", "cost", "upper", "lower").agg(
        F.sum("days").alias("total_days"), of(True, F.col("days")).alias("bull_days"), of(False, F.col("days")).alias("bear_days"),
        F.sum("flip").alias("transitions"), F.sum("gain").alias("log_bull"), of(False, F.col("grown")).alias("log_bear"),
        F.sum("grown").alias("log_all"), of(True, F.col("wins")).alias("bull_wins"), F.min(fall).alias("log_drop"))
    return _report(out, ["smooth", "cost", "upper", "lower"], min_transitions)


def evaluate(states: DataFrame, keys: list[str], min_transitions: int = 4) -> DataFrame:
    """Timing quality per combination from rows (d, ret, state); weak combinations are left out.

    Products of growth factors are sums of logarithms; growth factors are positive.
    """
    part = keys
    grown = F.col("_grown")
    df = states.where("ret is not null").withColumn("_grown", F.log1p("ret"))
    df = df.withColumn("_log", F.when(F.col("state") == 1, grown).otherwise(0.0))
    df = df.withColumns({
        "_flip": F.coalesce((F.col("state") != F.lag("state").over(by_date(part))).cast("int"), F.lit(0)),
        "_equity": F.sum("_log").over(up_to_now(part))})
    df = df.withColumn("_peak", F.max("_equity").over(up_to_now(part)))
    bull, bear = F.col("state") == 1, F.col("state") == 0
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_days"), F.count_if(bull).alias("bull_days"), F.count_if(bear).alias("bear_days"),
        F.sum("_flip").alias("transitions"), F.sum("_log").alias("log_bull"),
        F.sum(F.when(bear, grown).otherwise(0.0)).alias("log_bear"), F.sum(grown).alias("log_all"),
        F.count_if(bull & (F.col("ret") > 0)).alias("bull_wins"), F.min(F.col("_equity") - F.col("_peak")).alias("log_drop"))
    return _report(out, keys, min_transitions)


def _report(out: DataFrame, keys: list[str], min_transitions: int) -> DataFrame:
    out = out.where((F.col("total_days") >= 100) & (F.col("transitions") >= min_transitions)
                    & (F.col("bull_days") >= 20) & (F.col("bear_days") >= 20))

    def yearly(log, days):
        return (F.exp(F.col(log) * DAYS / F.col(days)) - 1) * 100

    pct = {
        "bull_cum_pct": (F.exp("log_bull") - 1) * 100, "bear_cum_pct": (F.exp("log_bear") - 1) * 100,
        "bull_annual_pct": yearly("log_bull", "bull_days"), "bear_annual_pct": yearly("log_bear", "bear_days"),
        "strategy_annual_pct": yearly("log_bull", "total_days"), "bh_annual_pct": yearly("log_all", "total_days"),
        "excess_annual_pct": yearly("log_bull", "total_days") - yearly("log_all", "total_days"),
        "bull_win_rate": F.col("bull_wins") / F.col("bull_days") * 100,
        "max_drawdown_pct": (F.exp("log_drop") - 1) * 100,
        "bull_ratio_pct": F.col("bull_days") / F.col("total_days") * 100,
    }
    return out.select(*keys, "total_days", "bull_days", "bear_days", "transitions",
                      *[F.round(v, 4).alias(n) for n, v in pct.items()])
