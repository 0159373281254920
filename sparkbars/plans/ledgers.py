"""Registered order, sizing, ledger and ledger-report queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkbars.functions.windows import prior
from sparkbars.operators import industry, ledger, metrics, orders, regime
from sparkbars.operators.indicators import dynamic_stops, indicators
from sparkbars.operators.signals import final_signals
from sparkbars.params import BEST, REGIME, V60, V61, V62, V63, V64
from sparkbars.plans.features import feature_frame, project
from sparkbars.sources import views

FLOW = replace(V64, smart_money=True)
LIMIT63 = replace(V63, limit_order=True)
LIMIT64 = replace(V64, limit_order=True)
EARLY = replace(BEST, early=True, strict_order=True)


def _ind(spark, root):
    return indicators(views.bars(spark, root))


def _round(trades):
    return trades.select("sym", "buy_date", "sell_date", F.round("buy_price", 2).alias("buy_price"),
                         F.round("sell_price", 2).alias("sell_price"), "shares", "hold_days",
                         F.round("profit_pct", 6).alias("profit_pct"), F.round("max_profit_pct", 6).alias("max_profit_pct"),
                         "exit_reason", "factor_details")


def ledger_for(spark, root, rules, version, signal, gate=None):
    df = feature_frame(spark, root, rules)
    allow = None
    if gate is not None:
        df, allow = gate(spark, root, df, rules), "allow"
    return ledger.trade_ledger(df, rules, version, signal, allow)


def industry_gate(spark, root, df, rules):
    """Industry momentum gate; industries and dates are a bounded dimension."""
    allowed = industry.allow_absolute(industry.momentum(views.bars(spark, root), views.universe(spark, root),
                                                        rules.industry_days), rules.industry_threshold)
    return _join_industry(spark, root, df, allowed)


def strength_gate(spark, root, df, rules):
    allowed = industry.allow_strength(industry.momentum(views.bars(spark, root), views.universe(spark, root),
                                                        rules.industry_days), rules.industry_top)
    return _join_industry(spark, root, df, allowed)


def _join_industry(spark, root, df, allowed):
    members = views.universe(spark, root).select("sym", "industry")
    df = df.join(members, "sym", "left").join(F.broadcast(allowed), ["industry", "d"], "left")  # features stay where they are
    return df.withColumn("allow", F.coalesce("allow", F.lit(True)))


def market_gate(spark, root, df, rules):
    """Market regime gate by date: one row per calendar date, so it is safe to broadcast."""
    states = regime.daily_state(views.market_daily(spark, root), **regime_settings())
    df = df.join(F.broadcast(states.select("d", (F.col("state") == 1).alias("allow"))), "d", "left")
    return df.withColumn("allow", F.coalesce("allow", F.lit(True)))


def regime_settings():
    return {k: REGIME[k] for k in ("smooth", "cost", "upper", "lower")}


LEDGERS = {
    "ledger_v60": (V60, 60, "signal_v60", None),
    "ledger_v61": (V61, 61, "signal_v61", None),
    "ledger_v62": (V62, 62, "signal_v61", industry_gate),
    "ledger_v63": (V63, 63, "signal_v63", strength_gate),
    "ledger_v63_limit": (LIMIT63, 63, "signal_v63", None),
    "ledger_v64": (V64, 64, "signal_v64", None),
    "ledger_v64_limit": (LIMIT64, 64, "signal_v64", None),
    "ledger_v64_best": (BEST, 64, "signal_v64", market_gate),
    "ledger_v64_early_strict": (EARLY, 64, "signal_v64", None),
}


def _ledger(name):
    return lambda spark, root: _round(ledger_for(spark, root, *LEDGERS[name]))


def best(spark, root):
    return ledger_for(spark, root, BEST, 64, "signal_v64")


def t1_entry_candidates(spark, root):
    df = feature_frame(spark, root, BEST)
    df = df.withColumn("after_signal", prior("signal_v64"))
    limit = F.col("prev_close") + BEST.gap_limit * F.col("prev_atr")
    verdict = F.when(F.col("open") > limit, "gap_up").when(F.col("open") < F.col("prev_yellow"), "below_line").otherwise("ok")
    return df.where("after_signal").select("sym", "d", "open", verdict.alias("verdict"))


def limit_price(spark, root):
    df = _ind(spark, root)
    raw = orders.limit_price(F.col("close"), F.col("yellow_line"), F.col("atr14"), V63)
    return df.select("sym", "d", raw.alias("limit_price"))


def _with_limit(spark, root):
    df = _ind(spark, root)
    df = df.withColumn("_lp", orders.limit_price(F.col("close"), F.col("yellow_line"), F.col("atr14"), V63))
    return df.withColumn("limit_price", prior("_lp")).where("limit_price is not null")


def limit_fill(spark, root):
    df = _with_limit(spark, root)
    fill = orders.limit_fill(F.col("limit_price"), F.col("open"), F.col("low"), F.col("volume"), F.col("volume_ma"))
    return df.withColumn("fill", fill).select("sym", "d", "fill.filled", F.col("fill.price").alias("fill_price"),
                                              F.col("fill.reason").alias("fill_reason"))


def limit_fill_simple(spark, root):
    df = _with_limit(spark, root)
    return df.select("sym", "d", orders.limit_fill_simple(F.col("limit_price"), F.col("open"), F.col("low")).alias("fill_price"))


def slippage_price(spark, root):
    df = views.bars(spark, root)
    return df.select("sym", "d", orders.with_slippage(F.col("open"), "buy").alias("buy_price"),
                     orders.with_slippage(F.col("open"), "sell").alias("sell_price"))


def shares_fixed(spark, root):
    return views.bars(spark, root).select("sym", "d", orders.fixed_shares(F.col("open"), V60).cast("bigint").alias("shares"))


def shares_vol_parity(spark, root):
    df = dynamic_stops(_ind(spark, root), V63)
    shares = orders.parity_shares(F.col("open"), F.col("prev_atr"), F.col("stop_multiple"), V63)
    return df.where("prev_atr is not null").select("sym", "d", shares.cast("bigint").alias("shares"))


def shares_score_scaled(spark, root):
    df = dynamic_stops(feature_frame(spark, root, V64), V64)
    shares = orders.parity_shares(F.col("open"), F.col("prev_atr"), F.col("stop_multiple"), V64)
    df = df.withColumn("entry_score", prior("score")).where("prev_atr is not null")
    return df.select("sym", "d", F.col("entry_score"), orders.scaled_shares(shares, F.col("entry_score"), V64).cast("bigint").alias("shares"))


def position_path(spark, root):
    """Every bar of every closed trade with running peak profit and trailing line."""
    folded = ledger.folded_ledgers(feature_frame(spark, root, BEST), BEST, 64, {"trades": "signal_v64"})

    def path(t):
        """Trades of one symbol do not overlap, so its bars from buying to selling are theirs alone."""
        held = F.filter("bars", lambda b: (b["d"] >= t["buy_date"]) & (b["d"] <= t["sell_date"]))
        return F.transform(held, lambda b: F.struct(
            b["d"].alias("d"), b["high"].alias("high"), b["close"].alias("close"), t["buy_date"].alias("buy_date"),
            t["sell_date"].alias("sell_date"), t["buy_price"].alias("buy_price"), b["atr"].alias("prev_atr"), b["hang"].alias("hang_multiple")))

    joined = folded.where("sym is not null").select("sym", F.inline(F.flatten(F.transform("trades", path))))
    trade = Window.partitionBy("sym", "buy_date").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.struct("prev_atr", "hang_multiple")).over(trade)
    gain = F.when(F.col("d") > F.col("buy_date"), (F.col("high") - F.col("buy_price")) / F.col("buy_price") * 100)
    joined = joined.withColumns({"f": first, "top": F.max("high").over(trade), "gain": gain})
    joined = joined.withColumn("peak", F.greatest(F.coalesce(F.max("gain").over(trade), F.lit(0.0)), F.lit(0.0)))
    line = F.greatest(F.col("top") - F.col("f.hang_multiple") * F.col("f.prev_atr"), F.lit(0.0))
    return joined.select("sym", "buy_date", "d", F.round("peak", 6).alias("peak_pct"), F.round(line, 6).alias("trailing_line"))


def tag_buy_climax_v60(spark, root):
    return _ind(spark, root).select("sym", "d", ledger.climax_v60(V60).alias("climax"))


def tag_buy_climax_v61(spark, root):
    return _ind(spark, root).select("sym", "d", ledger.climax_v61(V61).alias("climax"))


def ledger_regime_filter(spark, root):
    states = regime.daily_state(views.market_daily(spark, root), **regime_settings())
    gate = states.select(F.col("d").alias("buy_date"), (F.col("state") == 1).alias("allow"))
    trades = best(spark, root).join(gate, "buy_date", "left").where(F.coalesce("allow", F.lit(True)))
    return _round(trades)


def signal_counts(spark, root):
    return feature_frame(spark, root, BEST).groupBy("sym").agg(F.count_if("signal_v64").alias("signals"))


def ledger_by_symbol(spark, root):
    """Trades and signals of each symbol, counted where its bars are folded."""
    df = feature_frame(spark, root, BEST)
    return metrics.by_symbol(ledger.folded_ledgers(df, BEST, 64, {"trades": "signal_v64"}, None, F.count_if("signal_v64").alias("signals")))


def ledger_by_regime(spark, root):
    states = regime.daily_state(views.market_daily(spark, root), **regime_settings())
    gate = states.select(F.col("d").alias("buy_date"), F.col("state"))
    trades = best(spark, root).join(gate, "buy_date", "left").withColumn("state", F.coalesce("state", F.lit(-1)))
    return metrics.ledger_metrics(trades, ["state"]).drop("exits")


def _base_and_flow(spark, root):
    """Trades of V6.4 with and without the money-flow condition, per symbol: the two rule sets differ in the last stage of the signals only."""
    df = feature_frame(spark, root, V64).withColumn("signal_base", F.col("signal_v64"))
    return ledger.folded_ledgers(final_signals(df, FLOW), V64, 64, {"base": "signal_base", "flow": "signal_v64"})


def ledger_filtered_out(spark, root):
    return _round(_base_and_flow(spark, root).select("sym", F.inline(ledger.missing_from("base", "flow"))))


def ledger_ab_delta(spark, root):
    def side(name, number):
        return F.transform(name, lambda t: F.struct(F.lit(number).alias("side"), t["profit_pct"].alias("profit_pct")))

    return metrics.ab_delta(_base_and_flow(spark, root).select(F.inline(F.concat(side("base", 0), side("flow", 1)))))


def compare_signals_full_outer(spark, root):
    a = feature_frame(spark, root, V63).where("signal_v63").select("sym", "d", F.lit(True).alias("in_v63"))
    b = feature_frame(spark, root, V64).where("signal_v64").select("sym", "d", F.lit(True).alias("in_v64"))
    return a.join(b, ["sym", "d"], "full_outer").select(
        "sym", "d", F.coalesce("in_v63", F.lit(False)).alias("in_v63"), F.coalesce("in_v64", F.lit(False)).alias("in_v64"))


def benchmark_excess(spark, root):
    """Strategy total against the index over the same span, both also per year."""
    total = best(spark, root).agg(F.sum("profit_pct").alias("strategy"), F.min("buy_date").alias("d0"), F.max("sell_date").alias("d1"))
    index = views.index_daily(spark, root)
    one = total.withColumns({"first": index.agg(F.min_by("close", "d")).scalar(), "last": index.agg(F.max_by("close", "d")).scalar()})
    years = F.datediff("d1", "d0") / 365.25
    index_pct = (F.col("last") / F.col("first") - 1) * 100
    return one.select(F.round("strategy", 4).alias("strategy_pct"), F.round(index_pct, 4).alias("index_pct"),
                      F.round(F.col("strategy") - index_pct, 4).alias("excess_pct"),
                      F.round(F.col("strategy") / years, 4).alias("strategy_per_year"))


def _listed(df):
    """A map of exit reasons as text, reason:trades, in the order of the reasons."""
    return df.withColumn("exits", F.array_join(F.transform(F.map_entries("exits"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), "|"))


def queries() -> dict:
    out = {name: _ledger(name) for name in LEDGERS}
    out |= {f.__name__: f for f in (
        t1_entry_candidates, limit_price, limit_fill, limit_fill_simple, slippage_price, shares_fixed, shares_vol_parity,
        shares_score_scaled, position_path, tag_buy_climax_v60, tag_buy_climax_v61, ledger_regime_filter,
        ledger_by_symbol, ledger_by_regime, ledger_filtered_out, ledger_ab_delta, compare_signals_full_outer, benchmark_excess)}
    out |= {
        "ledger_metrics": lambda s, r: _listed(metrics.ledger_metrics(best(s, r))),
        "ledger_exit_counts": lambda s, r: _listed(metrics.exit_counts(best(s, r))),
        "ledger_by_exit": lambda s, r: metrics.by_exit(best(s, r)),
        "ledger_by_score": lambda s, r: metrics.by_score(best(s, r)),
        "ledger_breakdown_rollup": lambda s, r: metrics.breakdown(best(s, r)),
    }
    return out
