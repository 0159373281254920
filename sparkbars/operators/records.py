"""Signal records: labels, intraday advice, tiers and the filters of the daily scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.functions.windows import any_in, half_even, last_n, truth
from sparkbars.operators.indicators import GUARD, n_bar_return, slope_label
from sparkbars.params import Rules

c = F.col


def text(fmt: str, *values: Column) -> Column:
    return F.format_string(fmt, *values)


def labels(*pairs: tuple[Column, Column]) -> Column:
    """Array of the labels whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, label) for cond, label in pairs]))


def or_default(array: Column, default: Column) -> Column:
    return F.when(F.size(array) == 0, F.array(default)).otherwise(array)


def with_context(df: DataFrame, r: Rules) -> DataFrame:
    """Columns a record needs from neighbouring bars."""
    df = n_bar_return(slope_label(df), r.industry_days)
    marks = F.collect_list(F.when(c("anchor"), F.date_format("d", "MM-dd"))).over(last_n(r.window))
    return df.withColumns({
        "sos_dates": marks, "anchor_window": any_in("anchor", r.window + 1),
        "vol_ratio": F.when(c("volume_ma") > 0, c("volume") / c("volume_ma")).otherwise(0.0),
        "change_pct": c("daily_return"),
    })


def detail(df: DataFrame, r: Rules, extended: bool = False) -> DataFrame:
    """Reading of a bar in three vocabularies, with support and resistance; ``extended`` also names upper shadows and small bodies.

    Fixed values: the label texts.
    """
    wyckoff = labels(
        (c("anchor"), F.lit("SOS需求确认(主力入场)")), (c("no_supply"), F.lit("No Supply供应枯竭")),
        (c("test_bar"), F.lit("Test测试柱(需求保护)")),
        ((c("rn") > r.window) & c("anchor_window") & ~c("anchor"), F.lit(f"近{r.window}日有SOS锚定(LPS回踩)")),
        (c("j") < r.oversold, text("J=%.0f情绪冰点(超卖)", c("j"))))
    vpa = labels(
        (F.lit(True), F.when(c("vol_ratio") < r.quiet_volume, text("缩量(%.1f%%均量=供应枯竭)", c("vol_ratio") * 100))
         .otherwise(text("量比%.2f", c("vol_ratio")))),
        (c("body") / (c("close") + GUARD) < r.quiet_body, F.lit("小实体(多空平衡/拒绝下跌)")),
        (c("lower_shadow") > c("body") * 1.5, F.lit("下影线支撑(需求托底)")),
        (F.lit(extended) & (c("upper_shadow") > c("body") * 1.5), F.lit("上影线压力(供应出现)")))
    small = F.lit(extended) & (c("body") < c("amplitude") * 0.3)
    candle = (F.when(c("body") < c("amplitude") * 0.1, "十字星(方向选择)")
              .when(small & (c("close") > c("open")), "小阳线(温和看多)").when(small, "小阴线(温和看空)")
              .when((c("close") > c("open")) & (c("close_position") > 0.7), "阳线收高(强势)")
              .when((c("close") < c("open")) & (c("lower_shadow") > c("body") * 2), "锤子线(潜在反转)")
              .when(c("close") >= c("open"), "阳线").otherwise("阴线"))
    return df.withColumns({
        "wyckoff": or_default(wyckoff, F.lit("标准潜伏信号")), "vpa": vpa, "candle": F.array(candle),
        "support": c("yellow_line") - 0.5 * c("atr14"), "resistance": c("yellow_line") + 1.5 * c("atr14")})


def intraday_advice(df: DataFrame) -> DataFrame:
    """Buy-first or sell-first advice from the slope of the slow line.

    Fixed values: thresholds (amplitude 1.5 %, touch 0.5 %, J 20/80/100, stop 1.5 %, volume 0.8) and texts.
    """
    close, white, yellow, j = c("close"), c("white_line"), c("yellow_line"), c("j")
    to_yellow, to_white = (close - yellow) / yellow * 100, (close - white) / white * 100
    above_white, above_yellow, near = close > white, close > yellow, F.abs(to_yellow) <= 0.5
    amplitude = c("amplitude") / close * 100
    quiet = c("vol_ratio") < 0.8

    long_buy = labels(
        (near & (close >= yellow * (1 - 0.5 / 100)), text("回踩黄线%.2f(偏离%+.1f%%)", yellow, to_yellow)),
        (~above_white & (close < yellow) & (j < 20), text("超跌买(J=%.0f<20,跌破双线)", j)))
    long_sell = labels(
        (above_white & (j > 80), text("白线%.2f上方+J=%.0f>80", white, j)),
        (to_white > 3.0, text("正乖离过大(偏离白线%+.1f%%)", to_white)))
    short_sell = labels(
        (near & ~above_yellow, text("触黄线阻力%.2f(偏离%+.1f%%)", yellow, to_yellow)),
        (~above_white & (close < white), text("跌破白线%.2f", white)),
        ((j > 100) & above_white, text("超买卖(J=%.0f>100)", j)),
        ((to_white > 3.0) & above_white, text("正乖离过大(偏离白线%+.1f%%)", to_white)))
    short_buy = labels(
        (~above_white, text("回落至白线%.2f下方", white)),
        (near & quiet, text("黄线%.2f附近缩量止跌(量比%.1f)", yellow, c("vol_ratio"))))
    anchor = F.when(near, yellow).otherwise(white)

    def joined(array, default):
        return F.when(F.size(array) == 0, default).otherwise(F.array_join(array, " | "))

    up = c("slope") == "向上"
    blank = (c("rn") <= 5) | (close <= 0) | (yellow <= 0) | (white <= 0)
    idle = blank | (amplitude < 1.5)
    none = F.lit(None).cast("string")
    return df.withColumns({
        "t_mode": F.when(idle, "观望").when(up, "正T").otherwise("倒T"),
        "t_slope": F.when(blank, "走平").otherwise(c("slope")),
        "t_buy": F.when(idle, none).when(up, joined(long_buy, text("等待回踩黄线%.2f或超跌J<20", yellow)))
        .otherwise(joined(short_buy, text("等待回落至白线%.2f下方或黄线%.2f缩量", white, yellow))),
        "t_sell": F.when(idle, none).when(up, joined(long_sell, text("等待反弹至白线%.2f上方且J>80", white)))
        .otherwise(joined(short_sell, text("等待触黄线%.2f或跌破白线%.2f", yellow, white))),
        "t_risk": F.when(blank, none).when(idle, text("振幅仅%.1f%%，不足1.5%%，摩擦成本过高", amplitude))
        .when(up, text("跌破黄线1.5%%(%.2f)严格短线止损", yellow * (1 - 1.5 / 100)))
        .otherwise(text("突破%.2f的1.5%%(%.2f)立即买回防卖飞", anchor, anchor * (1 + 1.5 / 100))),
        "t_amplitude": F.when(~blank, amplitude)})


def tier(df: DataFrame) -> DataFrame:
    """Priority from score 8, volume below 0.3 or price 10-20; score 7 never; star bands."""
    price, ratio = half_even(c("close"), 2), half_even(c("vol_ratio"), 2)
    priority = ((c("score") >= 8) | (ratio < 0.3) | price.between(10, 20)) & (c("score") != 7)
    star = F.when(c("score") >= 7, "★★★").when(c("score") >= 5, "★★☆").otherwise("★☆☆")
    return df.withColumns({"priority": priority, "stars": star})


def season(day: Column) -> Column:
    """Dangerous and favourable months."""
    return F.when(F.month(day).isin(3, 5), "danger").when(F.month(day).isin(8, 10), "golden").otherwise("neutral")


def momentum_check(df: DataFrame, r: Rules) -> DataFrame:
    """Stock momentum against a floor that depends on the regime; passing adds to the score."""
    floor = F.when(c("bull"), r.momentum_floor_bull).otherwise(r.momentum_floor)
    ret = F.round("ret_n", 4)
    ok = truth(ret > floor)
    tag = F.when(ret.isNull(), "").when(ok, text("动量%+.1f%%", c("ret_n") * 100)).otherwise(
        text("动量不足%+.1f%%", c("ret_n") * 100))
    return df.withColumns({
        "momentum_ok": ok, "momentum_tag": tag,
        "score_before": c("score"), "score": F.when(ok, F.least(c("score") + r.momentum_boost, F.lit(8))).otherwise(c("score"))})


def survives(r: Rules, revival: bool = False) -> Column:
    """Industry and momentum gates, optionally with high scores brought back."""
    keep = c("industry_ok") & c("momentum_ok")
    if revival:
        by_industry = ~c("industry_ok") & (c("score_before") >= r.revive_industry_score)
        by_momentum = c("industry_ok") & ~c("momentum_ok") & (c("score_before") >= r.revive_momentum_score) & (
            c("eq_j") >= r.revive_j_score)
        keep = keep | by_industry | by_momentum
    return keep


def dynamic_score(r: Rules, bull: Column, j: Column, score: Column, ratio: Column) -> Column:
    """Final score filter; an unknown regime counts as bear."""
    exception = F.lit(r.score4_exception) & (score == 4) & (j < r.score4_j_max) & (ratio < r.score4_volume_max)
    by_regime = F.when(F.coalesce(bull, F.lit(False)), (score >= r.bull_min_score) | exception).otherwise(score >= r.bear_min_score)
    return by_regime & (j < r.j_cap) if r.j_cap > 0 else by_regime
