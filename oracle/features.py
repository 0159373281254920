from __future__ import annotations

from oracle.prelude import base, last, over, query, tags
from sparkbars.params import BEST
from sparkbars.plans.features import PROJECTIONS, parse

RENAMED = {"ema10": "e10", "ema12": "e12", "ema26": "e26"}
# Columns that need neither recurrences nor anything derived from them.
FIRST_LEVEL = ("ind_sma ind_yellow_line ind_atr14 ind_volume_ma ind_daily_return ind_obv ind_vwap ind_candle").split()


def columns(spec: str) -> str:
    out = []
    for alias, source, digits in parse(spec):
        source = RENAMED.get(source, source)
        out.append(f"{source} AS {alias}" if digits is None else f"round({source}, {digits}) AS {alias}")
    return ", ".join(out)


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (rules, spec) in PROJECTIONS.items():
        if name == "ind_ema":
            out[name] = query(f"SELECT sym, d, {columns(spec)} FROM rec JOIN row1 USING (sym, rn)", base())
        elif name in FIRST_LEVEL:
            out[name] = query(f"SELECT sym, d, {columns(spec)} FROM ind", base(rec=False))
        elif name in ("ind_white_line", "ind_kdj", "ind_macd"):
            out[name] = query(f"SELECT sym, d, {columns(spec)} FROM ind", base())
        else:
            out[name] = query(f"SELECT sym, d, {columns(spec)} FROM sig", base(), tags(rules))
    n = BEST.dynamic_lookback + 1
    stop, hang = BEST.dynamic_stop, BEST.dynamic_hang

    def pick(default, choice):
        return (f"CASE WHEN atr14 IS NULL OR atr14 <= 0 OR obs < 10 THEN {default}::DOUBLE WHEN share < {BEST.dynamic_low} THEN {choice[0]}::DOUBLE "
                f"WHEN share > {BEST.dynamic_high} THEN {choice[2]}::DOUBLE ELSE {choice[1]}::DOUBLE END")
    out["dynamic_stop_params"] = query(
        f"SELECT sym, d, round(share, 6) AS atr_share, {pick(BEST.stop_band, stop)} AS stop_multiple, "
        f"{pick(BEST.hang_band, hang)} AS hang_multiple FROM s", base(rec=False), f"""
        l AS (SELECT *, {last('list(atr14)', n)} AS recent FROM ind),
        s AS (SELECT *, len(recent) AS obs, len(list_filter(recent, lambda v: v < atr14)) / len(recent) * 100 AS share FROM l)""")
    k = BEST.industry_days
    out["stock_return_n"] = query(
        f"SELECT sym, d, round(CASE WHEN p > 0 THEN close / p - 1 END, 6) AS ret_n FROM "
        f"(SELECT *, {over(f'lag(close, {k})')} AS p FROM bars)", base(rec=False))
    out["slope_label"] = query(
        "SELECT sym, d, round(coalesce(p, 0), 6) AS slope_pct, CASE WHEN p > 0.3 THEN '向上' WHEN p < -0.3 THEN '向下' "
        "ELSE '走平' END AS slope FROM (SELECT *, (yellow_line - yellow_ago) / nullif(yellow_ago, 0) * 100 AS p FROM ind)",
        base(rec=False))
    return out
