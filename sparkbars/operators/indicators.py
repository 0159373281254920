"""Per-symbol indicators: every column is a built-in window expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbars.functions.recurrences import center_of_mass, ewm, span
from sparkbars.functions.windows import by_symbol, close_mean, gated, last_n, previous_n, prior, sequence, so_far

GUARD = 1e-8
FLOW_BARS = 8  # window of the money-flow structure


def candles(df: DataFrame) -> DataFrame:
    """Candle anatomy: body, shadows, range and where the close sits in the range."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    amplitude = F.col("high") - F.col("low")
    return df.withColumns({
        "body": F.abs(F.col("close") - F.col("open")),
        "lower_shadow": bottom - F.col("low"),
        "upper_shadow": F.col("high") - top,
        "amplitude": amplitude,
        "close_position": (F.col("close") - F.col("low")) / (amplitude + GUARD),
    })


def rolling(df: DataFrame) -> DataFrame:
    """All first-level windows over raw bar columns (one Window node)."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = {f"prev_{c}": prior(c) for c in ("open", "high", "low", "close", "volume", "amplitude")}
    out |= {f"ma{n}": close_mean(n) for n in (14, 28, 57, 114)}
    out |= {
        "volume_ma": F.avg("volume").over(last_n(20)),
        "low9": F.min("low").over(last_n(9)),
        "high9": F.max("high").over(last_n(9)),
        "cum_pv": F.sum(typical * F.col("volume")).over(so_far()),
        "cum_volume": F.sum("volume").over(so_far()),
        "low_before5": gated(F.min, "close", previous_n(5), 2),
        "low10": gated(F.min, "close", last_n(10), 5),
        "low12": gated(F.min, "close", last_n(12), 6),
        "volume_ma10": gated(F.avg, "volume", last_n(10), 5),
        "flow_high": F.max("close").over(last_n(FLOW_BARS)),
    }
    return df.withColumns(out)


def returns() -> dict:
    """Change of the close since the previous bar, as a share and in percent."""
    change = F.col("close") / F.nullif("prev_close", F.lit(0.0)) - 1
    return {"change": change, "daily_return": change * 100}


def derived(df: DataFrame) -> DataFrame:
    """Row-wise columns on top of ``rolling``."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return df.withColumns({
        "yellow_line": (F.col("ma14") + F.col("ma28") + F.col("ma57") + F.col("ma114")) / 4,
        "true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")),
                                 F.abs(F.col("low") - F.col("prev_close"))),
        **returns(),
        "rsv": F.coalesce((F.col("close") - F.col("low9")) / (F.col("high9") - F.col("low9") + GUARD) * 100,
                          F.lit(50.0)),
        "vwap": F.coalesce(F.col("cum_pv") / F.nullif("cum_volume", F.lit(0.0)), typical),
        "signed_volume": F.coalesce(F.signum(F.col("close") - F.col("prev_close")), F.lit(0.0)) * F.col("volume"),
    })


def recurrences(df: DataFrame) -> DataFrame:
    """Double-smoothed line, KDJ and MACD: two shared recurrence passes for all of them."""
    df = ewm(df, ["sym"], {
        "ema10": ("close", span(10)), "k_raw": ("rsv", center_of_mass(2)),
        "ema12": ("close", span(12)), "ema26": ("close", span(26)),
    }).withColumn("macd_dif", F.col("ema12") - F.col("ema26"))
    df = ewm(df, ["sym"], {
        "white_raw": ("ema10", span(10)), "d_raw": ("k_raw", center_of_mass(2)), "macd_dea": ("macd_dif", span(9)),
    })
    # Rounding far below a price tick keeps a flat series exactly flat.
    df = df.withColumns({
        "white_line": F.round("white_raw", 9), "k": F.col("k_raw"), "dd": F.col("d_raw"),
        "macd_hist": (F.col("macd_dif") - F.col("macd_dea")) * 2,
    })
    j = F.least(F.greatest(3 * F.col("k") - 2 * F.col("dd"), F.lit(0.0)), F.lit(100.0))
    return df.withColumn("j", j)


def neighbours() -> dict:
    """Columns that repeat a value of an earlier bar, with their distance in bars."""
    return {f"prev_{x}": (x, 1) for x in ("open", "high", "low", "close", "volume", "amplitude")} | {
        "prev_white": ("white_line", 1), "prev_yellow": ("yellow_line", 1), "prev_j": ("j", 1), "yellow_ago": ("yellow_line", 5),
        "prev_atr": ("atr14", 1), "prev2_atr": ("atr14", 2)}


def second_level(df: DataFrame) -> DataFrame:
    """Windows over derived columns."""
    return df.withColumns({
        "atr14": F.avg("true_range").over(last_n(14)),
        "obv": F.sum("signed_volume").over(so_far()),
        "prev_white": prior("white_line"), "prev_yellow": prior("yellow_line"), "prev_j": prior("j"),
        "prev_return": prior("daily_return"),
        "yellow_ago": prior("yellow_line", 5),
        "max_return30": F.max("daily_return").over(last_n(30)),
        "mean_return_before10": F.avg("daily_return").over(previous_n(10)),
        "low_hist12": gated(F.min, "macd_hist", last_n(12), 6),
    })


def third_level(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "prev_atr": prior("atr14"), "prev2_atr": prior("atr14", 2),
        "atr30": F.avg("atr14").over(last_n(30)),
        "low_obv10": gated(F.min, "obv", last_n(10), 5),
    })


STEPS = (candles, rolling, derived, recurrences, second_level, third_level)


def built(df: DataFrame, steps, needed: set[str] | None = None) -> DataFrame:
    """Apply steps in order, up to the first that provides all needed columns; no step changes a column of an earlier one."""
    for step in steps:
        if needed is not None and needed <= set(df.columns):
            break
        df = step(df)
    return df


def indicators(bars: DataFrame) -> DataFrame:
    """Bars plus every indicator column; unused columns are pruned by the optimizer."""
    return built(sequence(bars), STEPS)


def dynamic_stops(df: DataFrame, rules) -> DataFrame:
    """Stop and trailing multiples from the percentile of today's ATR in its recent window.

    The window is a bounded array of lookback+1 values, not a group.
    """
    recent = F.collect_list("atr14").over(last_n(rules.dynamic_lookback + 1))
    below = F.size(F.filter("_recent", lambda v: v < F.col("atr14")))
    # The share is a column of its own, so the array is gone through once a row and not in each branch that compares it.
    df = df.withColumn("_recent", recent).withColumns({
        "atr_share": below / F.nullif(F.size("_recent"), F.lit(0)) * 100, "_known": F.size("_recent")})
    share = F.col("atr_share")
    thin = F.col("atr14").isNull() | (F.col("atr14") <= 0) | (F.col("_known") < 10)

    def pick(default, choice):
        if not rules.dynamic:
            return F.lit(float(default))
        return (F.when(thin, F.lit(float(default))).when(share < rules.dynamic_low, F.lit(choice[0]))
                .when(share > rules.dynamic_high, F.lit(choice[2])).otherwise(F.lit(choice[1])))

    return df.withColumns({
        "stop_multiple": pick(rules.stop_band, rules.dynamic_stop),
        "hang_multiple": pick(rules.hang_band, rules.dynamic_hang),
    }).drop("_recent", "_known")


def slope_label(df: DataFrame) -> DataFrame:
    """Direction of the slow line over five bars, with its size in percent."""
    pct = (F.col("yellow_line") - F.col("yellow_ago")) / F.nullif("yellow_ago", F.lit(0.0)) * 100
    # Direction labels up, down, flat.
    label = F.when(pct > 0.3, "向上").when(pct < -0.3, "向下").otherwise("走平")
    return df.withColumns({"slope_pct": F.coalesce(pct, F.lit(0.0)), "slope": label})


def n_bar_return(df: DataFrame, n: int) -> DataFrame:
    before = prior("close", n)
    value = F.when(before > 0, F.col("close") / before - 1)
    return df.withColumn("ret_n", value)


__all__ = ["indicators", "candles", "dynamic_stops", "slope_label", "n_bar_return", "by_symbol"]
