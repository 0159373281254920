"""Pattern tags, quality scores and the staged entry signals.

Stages follow one another as DataFrame transforms, so a user adds a stage of their own with
``df.transform``: indicators -> tags -> scores -> signals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.functions.windows import any_in, as_points, count_in, last_n, previous_n, prior, seen_before, truth
from sparkbars.operators.indicators import FLOW_BARS, GUARD
from sparkbars.params import Rules

c = F.col


def row_tags(df: DataFrame, r: Rules) -> DataFrame:
    """Everything decided by one bar and its indicators, for all stages."""
    change = F.coalesce(c("change"), F.lit(0.0))
    up, down = truth(c("close") > c("prev_close")), truth(c("close") < c("prev_close"))
    vol = c("volume") / F.nullif("prev_volume", F.lit(0.0))
    slow, atr = c("yellow_line"), c("atr14")
    if r.flow_lookback != FLOW_BARS:
        df = df.withColumn("flow_high", F.max("close").over(last_n(r.flow_lookback)))
    df = df.withColumns({
        # supply running dry, and bars that test the slow line
        "trend_ok": truth((c("white_line") > slow) & (c("close") > slow)),
        "no_supply": truth((c("volume") < c("volume_ma") * r.dry_volume) & (c("volume") < c("prev_volume"))
                           & (c("amplitude") < c("prev_amplitude"))),
        "test_bar": truth((c("low") <= slow + r.touch_band * atr) & (c("close") > c("low"))
                          & (c("lower_shadow") > c("body") * 1.5)
                          & (c("volume") < c("volume_ma") * r.test_volume)),
        "lively": truth((c("daily_return") > 9.5) | truth(c("amplitude") / (c("prev_close") + GUARD) > 0.10)),
        "dragon": truth(c("max_return30") > c("atr30") / (c("close") + GUARD) * r.dragon_multiple),
        "in_support": truth(c("close") > slow - r.support_band * atr),
        "not_over": truth(c("close") <= slow + r.overshoot_band * atr),
        # quiet pull-back
        "oversold": truth(c("j") < r.oversold),
        "volume_quiet": truth(c("volume") < c("volume_ma") * r.quiet_volume),
        "body_quiet": truth(c("body") / (c("close") + GUARD) < r.quiet_body),
        "support_ok": truth(c("close") > slow - r.quiet_support * atr),
        "rebound_ok": truth(c("lower_shadow") > c("body") * r.rebound_shadow) | truth(c("close") > c("open"))
        | truth(c("j") > c("prev_j")),
        # small-scale stabilisation
        "above_vwap": truth(c("close") > c("vwap")),
        "inside_bar": truth((c("high") <= c("prev_high")) & (c("low") >= c("prev_low"))),
        "range_shrink": truth((atr < c("prev_atr")) & (c("prev_atr") < c("prev2_atr"))),
        "lower_wick": truth((c("lower_shadow") > c("body") * 0.8)
                            & (c("volume") / F.nullif("volume_ma", F.lit(0.0)) < 0.9)),
        # footprints of a large buyer
        "calm": truth((c("volume") < c("volume_ma") * 0.85) & (c("close") >= c("low_before5") - 0.5 * atr)),
        "touch": truth((c("low") <= slow + 0.8 * atr) & (c("low") >= slow - 0.8 * atr) & (c("close") >= slow - 0.1 * atr)),
        "gather": truth(c("lower_shadow") > c("body") * 1.5) | truth(c("close_position") > 0.65) | truth(
            (c("close") > c("open")) & (c("volume") < c("volume_ma") * 0.8) & (c("body") / (c("close") + GUARD) < 0.03)),
        "factor_b": truth((c("close") <= c("low10") * 1.01) & (c("obv") > c("low_obv10") * 1.05)),
        "factor_b_volume": truth((c("close") <= c("low10") * 1.01) & (c("volume") < c("volume_ma10"))),
        "factor_e": truth((c("close") <= c("low12") * 1.01) & (c("macd_hist") > c("low_hist12") + 1e-4)
                          & (c("macd_hist") < 0)),
        # money flow
        "flow_up": truth(up & (change >= r.flow_up_return) & (vol >= r.flow_up_volume)),
        "flow_down": down,
        "flow_down_quiet": truth(down & (vol <= r.flow_pullback_volume)),
        "flow_gain": F.when(up, c("volume") * F.greatest(change, F.lit(0.0))).otherwise(F.lit(0.0)),
        "flow_loss": F.when(down, c("volume") * -F.least(change, F.lit(0.0))).otherwise(F.lit(0.0)),
        "flow_heavy": truth((c("close") >= c("flow_high") * r.flow_near_high) & down
                            & ((c("prev_close") - c("close")) / F.nullif("prev_close", F.lit(0.0)) >= r.flow_heavy_drop)
                            & (vol >= r.flow_heavy_volume)),
        "crossed": truth((c("white_line") > slow) & (c("prev_white") <= c("prev_yellow"))),
        "rising": truth(slow > c("yellow_ago")),
    })
    dry = c("no_supply") | c("test_bar")
    return df.withColumns({"dry": dry, "dry_volume": F.when(dry, c("volume")).otherwise(F.lit(0.0))})


def tag_windows(df: DataFrame, r: Rules) -> DataFrame:
    """All windows over row tags: one Window node for every stage."""
    n = r.flow_lookback
    downs = count_in("flow_down", n)
    return df.withColumns({
        "dry_recent": seen_before("dry", 3),
        "dry_volume_max": F.max("dry_volume").over(previous_n(3)),
        "active": any_in("lively", 20),
        "factor_a": count_in("calm", 2) >= 2,
        "factor_c": count_in("touch", 8) >= 2,
        "factor_d": count_in("gather", 3) >= 1,
        "sm_strong_up": count_in("flow_up", n) >= 1,
        "sm_pullback_shrink": (downs == 0) | truth(count_in("flow_down_quiet", n) / F.nullif(downs, F.lit(0))
                                                   >= r.flow_pullback_share),
        "sm_dominance": F.sum("flow_gain").over(last_n(n)) >= F.sum("flow_loss").over(last_n(n)) * r.flow_dominance,
        "sm_no_distribution": count_in("flow_heavy", n) <= r.flow_heavy_days,
        "crossed_recent": any_in("crossed", r.cross_lookback),
    })


def anchors(df: DataFrame, r: Rules) -> DataFrame:
    """Demand bar within its guard rails after supply ran dry, and whether one was seen lately."""
    demand = (c("volume") > c("volume_ma") * r.demand_vs_average) & (c("volume") > c("dry_volume_max") * r.demand_vs_dry)
    df = df.withColumn("demand_bar", truth(
        (c("close") > c("open")) & (c("body") / (c("amplitude") + GUARD) > r.body_share)
        & (c("close_position") > r.close_location) & demand & (c("close") > F.greatest("prev_open", "prev_close"))))
    anchor = reduce(lambda a, b: a & b, [c(n) for n in (
        "trend_ok", "dry_recent", "demand_bar", "in_support", "not_over", "active", "dragon")])
    return df.withColumn("anchor", anchor).withColumn("anchor_recent", seen_before("anchor", r.window))


def quiet_signals(df: DataFrame, r: Rules) -> DataFrame:
    """Quiet pull-back after an anchor, how many of its five conditions hold, and the confirmations."""
    parts = [c(n) for n in ("anchor_recent", "oversold", "volume_quiet", "body_quiet", "support_ok")]
    chosen = [c(n) for n, on in (("above_vwap", r.micro_vwap), ("inside_bar", r.micro_inside),
                                 ("range_shrink", r.micro_shrink), ("lower_wick", r.micro_wick)) if on]
    combine = (lambda a, b: a & b) if r.micro_all else (lambda a, b: a | b)
    df = df.withColumns({
        "signal_v60": reduce(lambda a, b: a & b, parts), "near_count": as_points(*parts),
        "micro_ok": reduce(combine, chosen) if chosen else F.lit(True)})
    df = df.withColumn("signal_v61", c("signal_v60") & c("rebound_ok") if r.rebound else c("signal_v60"))
    return df.withColumn("signal_v63", c("signal_v61") & c("micro_ok") if r.micro else c("signal_v61"))


def quality_scores(df: DataFrame, r: Rules) -> DataFrame:
    """Entry quality: partial scores of 0-2 points and their sum, capped at eight."""
    ratio = c("volume") / (c("volume_ma") + GUARD)
    candle = as_points(truth(c("lower_shadow") > c("body") * r.candle_shadow),
                       truth(c("body") / (c("close") + GUARD) < r.candle_body), truth(c("close") > c("open")))
    near = prior("near_count") >= r.persist_conditions
    near2 = prior("near_count", 2) >= r.persist_conditions
    df = df.withColumns({
        "support_score": sum((c(f"factor_{x}").cast("int") * w for x, w in zip("abcde", r.support_weights, strict=True)), F.lit(0)),
        "flow_score": as_points(c("sm_strong_up"), c("sm_pullback_shrink"), c("sm_dominance"), c("sm_no_distribution")),
        "eq_persist": F.when(truth(near) | truth(near2), r.persist_points).otherwise(0),
    })
    df = df.withColumns({
        "flow_ok": c("flow_score") >= r.flow_min_score,
        "eq_j": F.when(c("j") < r.j_extreme, 2).when(c("j") < r.j_low, 1).otherwise(0),
        "eq_volume": F.when(ratio < r.volume_extreme, 2).when(ratio < r.volume_low, 1).otherwise(0),
        "eq_candle": F.least(candle, F.lit(r.candle_cap)),
        "eq_ma": F.when(c("white_line") > c("yellow_line"), 2).when(c("crossed_recent"), 1)
        .when(F.abs(c("white_line") - c("yellow_line")) < r.converge_band * c("atr14"), 1).otherwise(0),
        "eq_support": F.when(c("support_score") >= r.support_two, 2).when(c("support_score") >= r.support_one, 1)
        .otherwise(0),
    })
    total = c("eq_j") + c("eq_volume") + c("eq_candle") + c("eq_ma") + c("eq_support")
    if r.persist:
        total = total + c("eq_persist")
    return df.withColumn("score", F.least(F.greatest(total, F.lit(0)), F.lit(8)))


def quality_gate(r: Rules) -> Column:
    score, v, j = c("score"), c("eq_volume"), c("eq_j")
    keep = (score >= r.min_score) & ((score < r.rising_from_score) | c("rising"))
    keep = keep & ~((score == 3) & (v == 1) & (j == 0))
    if r.drop_weak_score4:
        keep = keep & ~((score == 4) & (j == 1) & (v == 0) & (c("eq_candle") == 1) & (c("eq_ma") == 2))
    return keep


def support_gate(r: Rules) -> Column:
    keep = c("support_score") >= r.support_min
    for factor in r.support_needs:
        keep = keep & c(f"factor_{factor}")
    return keep


def final_signals(df: DataFrame, r: Rules) -> DataFrame:
    structure = c("anchor_recent") & c("support_ok")
    if r.structure_micro:
        structure = structure & c("micro_ok")
    if r.smart_money:
        structure = structure & c("flow_ok")
    df = df.withColumn("signal_structure", structure)
    signal = c("signal_structure") if r.structure else c("signal_v63")
    if r.quality:
        signal = signal & quality_gate(r)
    if r.support_gate:
        signal = signal & support_gate(r)
    quality_code = F.format_string("J%dV%dC%dM%d", "eq_j", "eq_volume", "eq_candle", "eq_ma")
    support_code = F.format_string("A%dB%dC%dD%d", *[c(f"factor_{x}").cast("int") for x in "abcd"])
    return df.withColumns({"signal_v64": signal, "support_code": support_code, "factor_code": quality_code if r.quality else support_code})


STEPS = (row_tags, tag_windows, anchors, quiet_signals, quality_scores, final_signals)


def signals(df: DataFrame, r: Rules) -> DataFrame:
    """All tags, scores and signals of a rule set on top of ``indicators``."""
    for step in STEPS:
        df = step(df, r)
    return df
