"""The ledger fold against an independent bar-by-bar walk, and its invariants."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sparkbars.operators import ledger
from sparkbars.operators.indicators import indicators
from sparkbars.operators.signals import signals
from sparkbars.params import BEST, V60, V61, V63
from tests.test_bars import SCHEMA, walk

CASES = [(V60, 60), (V61, 61), (V63, 63), (BEST, 64), (replace(BEST, early=True, strict_order=True), 64)]


def label(r, version, p, row, pnl):
    peak, hold = p["peak"], p["hold"]
    stop, climax = pnl <= -(p["stop"] * p["atr"] / p["price"]), row.climax and peak >= r.climax_peak
    if version == 60:
        order = [(stop, "ATR_HARD_STOP"), (peak >= r.trail_trigger and peak - pnl >= r.trail_drop, "TRAILING_TAKE"),
                 (r.keep_low <= peak < r.keep_high and pnl <= r.keep_level, "BREAKEVEN_STOP"), (climax, "BUY_CLIMAX"),
                 (hold >= r.idle_days and pnl <= r.idle_return, "TIME_STOP"), (row.cross_down, "DEATH_CROSS"), (hold >= r.max_days, "MAX_HOLD")]
        return next((name for cond, name in order if cond), None)
    first = "BREAKEVEN_STOP" if version >= 64 and r.break_even and peak >= r.break_even_trigger and pnl <= r.break_even_level else None
    first = first or ("ATR_HARD_STOP" if stop else "CHANDELIER_EXIT" if row.close < p["line"] and hold >= r.hang_min_days else
                      "BUY_CLIMAX" if climax else None)
    days = r.idle_days_by_score.get(p["score"], r.idle_days) if version >= 64 else r.idle_days
    if version >= 63 and pnl * 100 >= r.extend_from:
        days = r.extend_days
    timed = "TIME_STOP" if (hold >= days and pnl < r.idle_return) or hold >= r.max_days or row.cross_down else None
    if version < 64:
        return first or timed
    if r.early and hold >= r.early_days and pnl < r.early_return:
        late = "EARLY_EXIT"
    elif r.tiers and peak >= r.tier_from:
        drop = r.tier_drop[2] if peak >= 0.2 else r.tier_drop[1] if peak >= 0.1 else r.tier_drop[0]
        late = "PROFIT_TIER" if peak - pnl >= drop else first
    else:
        late = timed or first
    return (first or late) if r.strict_order else late


def brute(rows, r, version):
    pending, p, out = False, None, []
    for row in rows:
        if pending:
            pending = False
            if row.can_enter:
                p = dict(d=row.d, price=row.fill, atr=row.prev_atr, size=row.size, stop=row.stop_multiple, hang=row.hang_multiple,
                         score=row.entry_score, hold=0, peak=0.0, top=row.high, line=max(0.0, row.high - row.hang_multiple * row.prev_atr))
            continue
        if p is None:
            pending = row.is_signal
            continue
        p["hold"] += 1
        pnl = (row.close - p["price"]) / p["price"]
        p["peak"] = max(p["peak"], (row.high - p["price"]) / p["price"])
        p["top"] = max(p["top"], row.high)
        p["line"] = max(p["line"], p["top"] - p["hang"] * p["atr"])
        why = label(r, version, p, row, pnl)
        if why:
            out.append((p["d"], row.d, p["hold"], why, round(pnl * 100, 8)))
            p = None
    return out


@pytest.fixture(scope="module")
def market(spark):
    rows = [r for s in range(8) for r in walk(400, 1000 + s, sym=s, drift=0.0005 * (s - 3))]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("rules,version", CASES)
def test_fold_matches_bar_by_bar_walk(spark, market, rules, version):
    df = signals(indicators(market), rules).withColumn("entry", F.col("support_ok") & (F.col("rn") % 3 == 0)).cache()
    plain = ledger.entry_columns(df, rules, version, "entry", None).orderBy("sym", "d").collect()
    trades = ledger.trade_ledger(df, rules, version, "entry").orderBy("sym", "buy_date").collect()
    assert trades
    for sym in range(8):
        got = [(t.buy_date, t.sell_date, t.hold_days, t.exit_reason, round(t.profit_pct, 8)) for t in trades if t.sym == sym]
        assert got == brute([x for x in plain if x.sym == sym], rules, version)
        for a, b in zip(got, got[1:]):
            assert a[0] < a[1] < b[0]


def test_ledgers_of_one_frame_share_its_windows(spark, market):
    """Two ledgers, signal counts and paths come from one pass over the features: their plans hold each window once."""
    from sparkbars.plans import ledgers
    from tests.test_queries import ROOT

    def windows(name):
        plan = ledgers.queries()[name](spark, ROOT)._jdf.queryExecution().optimizedPlan().toString()
        return sum(line.lstrip(" :+-").startswith("Window [") for line in plan.splitlines())

    one = windows("ledger_v64")
    assert windows("ledger_ab_delta") <= one + 1 and windows("ledger_filtered_out") <= one + 1
    assert windows("ledger_by_symbol") <= one and windows("position_path") <= one + 2


def test_folded_ledgers_equal_those_folded_alone(spark, market):
    df = signals(indicators(market), BEST).withColumns({
        "a": F.col("support_ok") & (F.col("rn") % 3 == 0), "b": F.col("support_ok") & (F.col("rn") % 5 == 0)}).cache()
    both = ledger.folded_ledgers(df, BEST, 64, {"x": "a", "y": "b"})
    alone = {n: ledger.trade_ledger(df, BEST, 64, n).select("sym", "buy_date", "sell_date").collect() for n in "ab"}
    for column, name in (("x", "a"), ("y", "b")):
        got = both.select("sym", F.inline(column)).select("sym", "buy_date", "sell_date").collect()
        assert got and sorted(got) == sorted(alone[name])
    lacking = both.select("sym", F.inline(ledger.missing_from("x", "y"))).select("sym", "buy_date").collect()
    assert sorted(lacking) == sorted({(t.sym, t.buy_date) for t in alone["a"]} - {(t.sym, t.buy_date) for t in alone["b"]})


def test_metrics_count_the_trades_of_each_exit(spark):
    """Figures and exit counts by hand, whole and by key; a trade without a figure is in no mean, one without a reason in no exit."""
    from sparkbars.operators import metrics

    schema = "k int, profit_pct double, hold_days bigint, max_profit_pct double, exit_reason string"
    rows = [(1, 4.0, 3, 6.0, "PROFIT_TIER"), (1, 2.0, 4, 2.0, "TIME_STOP"), (1, -3.0, 6, 1.0, "TIME_STOP"), (2, 0.0, 7, None, "TIME_STOP"),
            (2, None, None, 3.0, None)]
    trades = spark.createDataFrame(rows, schema)
    whole = metrics.ledger_metrics(trades).first()
    assert whole.exits == {"PROFIT_TIER": 1, "TIME_STOP": 3}
    assert tuple(whole)[:-1] == (5, 2, 2, 40.0, 0.75, 3.0, 1.5, 2.0, 5.0, 3.0, 3.0)
    by = {r.k: r for r in metrics.ledger_metrics(trades, ["k"]).collect()}
    assert by[1].exits == {"PROFIT_TIER": 1, "TIME_STOP": 2} and by[2].exits == {"TIME_STOP": 1}
    assert (by[1].avg_win, by[1].avg_loss, by[2].avg_win, by[2].avg_loss, by[2].profit_factor) == (3.0, 3.0, 0.0, 0.0, 999.0)
    none = metrics.ledger_metrics(trades.where("false")).first()
    assert (none.total, none.wins, none.win_rate, none.avg_loss, none.total_profit, none.exits) == (0, 0, None, 0.01, 0.0, {})
