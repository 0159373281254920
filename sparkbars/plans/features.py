"""Registered indicator, tag, score and signal queries: a projection of the feature frame each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbars.functions.windows import sequence
from sparkbars.operators.indicators import STEPS, built, dynamic_stops, indicators, n_bar_return, slope_label
from sparkbars.operators.signals import STEPS as SIGNAL_STEPS
from sparkbars.params import BEST, V60, V61, V63, V64, Rules
from sparkbars.sources import views


def feature_frame(spark: SparkSession, root: str, rules: Rules = BEST, raw: bool = False, needed: set[str] | None = None) -> DataFrame:
    """Indicators, tags, scores and signals; with ``needed``, only the stages that provide these columns are planned."""
    bars = views.bars_raw(spark, root) if raw else views.bars(spark, root)
    steps = [*STEPS, *(lambda df, step=step: step(df, rules) for step in SIGNAL_STEPS)]
    return built(sequence(bars), steps, needed)


# name -> (rules, columns); "a=b" renames b to a, ":n" rounds a double to n digits.
# V6.4 without quality scores, gated by weighted institutional support with factor A required.
SUPPORT = replace(V64, quality=False, support_gate=True, support_min=3, support_needs="a", support_weights=(2, 1, 1, 2, 1))

PROJECTIONS = {
    "ind_sma": (BEST, "ma14:8 ma28:8 ma57:8 ma114:8"),
    "ind_ema": (BEST, "ema10:6 ema12:6 ema26:6"),
    "ind_white_line": (BEST, "white_line:6"),
    "ind_yellow_line": (BEST, "yellow_line:8"),
    "ind_atr14": (BEST, "true_range:6 atr14:6"),
    "ind_volume_ma": (BEST, "volume_ma:6"),
    "ind_daily_return": (BEST, "daily_return:6"),
    "ind_kdj": (BEST, "k_value=k:6 d_value=dd:6 j:6"),
    "ind_macd": (BEST, "macd_dif:6 macd_dea:6 macd_hist:6"),
    "ind_obv": (BEST, "obv:2"),
    "ind_vwap": (BEST, "vwap:8"),
    "ind_candle": (BEST, "body:6 upper_shadow:6 lower_shadow:6 amplitude:6 close_position:6"),
    "tag_above_vwap": (BEST, "above_vwap"),
    "tag_inside_bar": (BEST, "inside_bar"),
    "tag_vcp_shrink": (BEST, "range_shrink"),
    "tag_lower_wick": (BEST, "lower_wick"),
    "tag_trend_ok": (BEST, "trend_ok"),
    "tag_no_supply": (BEST, "no_supply"),
    "tag_test": (BEST, "test_bar"),
    "depletion_window": (BEST, "dry_recent dry_volume_max:2"),
    "tag_sos": (BEST, "demand_bar"),
    "guard_rails": (BEST, "in_support not_over"),
    "stock_activity": (BEST, "active dragon"),
    "tag_sos_anchor": (BEST, "anchor"),
    "sos_in_window": (BEST, "anchor_recent"),
    "signal_v60": (V60, "signal_v60"),
    "near_signal_count": (V60, "near_count"),
    "signal_v61": (V61, "rebound_ok signal_v61"),
    "micro_confirm": (V63, "micro_ok"),
    "signal_v63": (V63, "signal_v63"),
    "eq_j_score": (BEST, "eq_j"),
    "eq_vol_score": (BEST, "eq_volume"),
    "eq_candle_score": (BEST, "eq_candle"),
    "eq_ma_score": (BEST, "eq_ma"),
    "eq_support_score": (BEST, "eq_support"),
    "eq_persist_score": (BEST, "eq_persist"),
    "entry_quality_score": (BEST, "score"),
    "eq_trend_rising": (BEST, "rising"),
    "factor_a": (BEST, "factor_a"),
    "factor_b": (BEST, "factor_b factor_b_volume"),
    "factor_c": (BEST, "factor_c"),
    "factor_d": (BEST, "factor_d"),
    "factor_e": (BEST, "factor_e"),
    "inst_support_score": (BEST, "support_score"),
    "sm_strong_up": (BEST, "sm_strong_up"),
    "sm_pullback_shrink": (BEST, "sm_pullback_shrink"),
    "sm_red_green": (BEST, "sm_dominance"),
    "sm_no_distribution": (BEST, "sm_no_distribution"),
    "smart_money_score": (BEST, "flow_score flow_ok"),
    "signal_structure": (V64, "signal_structure"),
    "signal_v64": (V64, "signal_v64"),
    "signal_v64_best": (BEST, "signal_v64"),
    "signal_v64_support": (SUPPORT, "signal_v64 support_score factor_code"),
    "signal_structure_plain": (replace(V64, structure_micro=False), "signal_structure"),
    "factor_code": (BEST, "factor_code support_code"),
}


def parse(columns: str) -> list[tuple[str, str, int | None]]:
    out = []
    for item in columns.split():
        name, _, digits = item.partition(":")
        alias, _, source = name.partition("=")
        out.append((alias, source or alias, int(digits) if digits else None))
    return out


def project(df: DataFrame, columns: str) -> DataFrame:
    exprs = []
    for alias, source, digits in parse(columns):
        value = F.col(source) if digits is None else F.round(source, digits)
        exprs.append(value.alias(alias))
    return df.select("sym", "d", *exprs)


def _projection(rules: Rules, columns: str):
    needed = {source for _, source, _ in parse(columns)}
    return lambda spark, root: project(feature_frame(spark, root, rules, needed=needed), columns)


def dynamic_stop_params(spark, root):
    df = dynamic_stops(indicators(views.bars(spark, root)), BEST)
    return project(df, "atr_share:6 stop_multiple hang_multiple")


def stock_return_n(spark, root):
    return project(n_bar_return(indicators(views.bars(spark, root)), BEST.industry_days), "ret_n:6")


def slope(spark, root):
    return project(slope_label(indicators(views.bars(spark, root))), "slope_pct:6 slope")


def queries() -> dict:
    out = {name: _projection(*spec) for name, spec in PROJECTIONS.items()}
    return out | {"dynamic_stop_params": dynamic_stop_params, "stock_return_n": stock_return_n, "slope_label": slope}
