"""Entry/exit pairing over bars: one fold per symbol, inside the JVM.

Whatever depends on the bar and its predecessor only (entry guards, fill price, size, exit
flags) is computed as ordinary columns first. What is left, the open position, is carried
through ``aggregate`` over the symbol's bars in time order. Bars are unique on (sym, d), so
the array of one symbol is bounded by the number of calendar dates, whatever the trade skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.functions.windows import prior, truth
from sparkbars.operators import orders
from sparkbars.operators.indicators import GUARD, dynamic_stops
from sparkbars.params import Rules

POSITION = ("struct<entry_d:date,price:double,atr:double,shares:bigint,stop:double,hang:double,score:int,code:string,"
            "hold:int,peak:double,top:double,line:double>")
TRADE = ("struct<buy_date:date,sell_date:date,buy_price:double,sell_price:double,shares:bigint,hold_days:int,"
         "profit_pct:double,max_profit_pct:double,exit_reason:string,factor_details:string>")


def climax_v60(r: Rules) -> Column:
    """Heavy volume, stalled return and a supply candle (peak profit is checked in the fold)."""
    mean, ret = F.col("mean_return_before10"), F.coalesce(F.col("daily_return"), F.lit(0.0))
    moving = truth((mean == 0) | (F.abs(ret) >= F.abs(mean) * r.climax_return))
    supply = (F.col("upper_shadow") > F.col("body") * 1.5) | (
        (F.col("close") < F.col("open")) & (F.col("body") / (F.col("amplitude") + GUARD) > 0.6))
    return truth((F.col("volume") > F.col("volume_ma") * r.climax_volume) & ~moving & supply)


def climax_v61(r: Rules) -> Column:
    """Heavy volume without progress and a long upper shadow."""
    return truth((F.col("volume") / (F.col("volume_ma") + GUARD) > r.climax_volume)
                 & (F.col("body") / (F.col("close") + GUARD) < r.climax_body)
                 & (F.col("upper_shadow") > F.col("body") * r.climax_shadow))


def _allowed(signal: str, allow: str, version: int) -> Column:
    return truth(F.col(signal)) & (F.col(allow) if version >= 61 else F.lit(True))


def entry_columns(df: DataFrame, r: Rules, version: int, signal: str, allow: str | None) -> DataFrame:
    """Per-bar decisions: is this bar a legal entry after a signal, at what price and size."""
    df = dynamic_stops(df, r)
    if allow is None:
        df, allow = df.withColumn("_allow", F.lit(True)), "_allow"
    open_, low = F.col("open"), F.col("low")
    fill = open_
    if r.limit_order:
        df = df.withColumn("_limit", orders.limit_price(F.col("close"), F.col("yellow_line"), F.col("atr14"), r))
        df = df.withColumn("_limit", prior("_limit"))
        if version >= 64:
            fill = orders.limit_fill_simple(F.col("_limit"), open_, low)
        else:
            order = orders.limit_fill(F.col("_limit"), open_, low, F.col("volume"), F.col("volume_ma"))
            fill = F.when(order["filled"], order["price"])
    df = df.withColumns({"fill": fill, "entry_score": prior("score"), "entry_code": prior("factor_code")})
    if r.parity:
        shares = orders.parity_shares(F.col("fill"), F.col("prev_atr"), F.col("stop_multiple"), r)
    else:
        shares = orders.fixed_shares(F.col("fill"), r)
    if version >= 64:
        shares = orders.scaled_shares(shares, F.col("entry_score"), r)
    df = df.withColumn("size", shares.cast("bigint"))
    guards = (open_ <= F.col("prev_close") + r.gap_limit * F.col("prev_atr")) & (open_ >= F.col("prev_yellow"))
    return df.withColumns({
        "can_enter": truth(guards & (open_ > 0) & F.col(allow) & (F.col("size") > 0)),
        "is_signal": _allowed(signal, allow, version),
        "climax": climax_v60(r) if version == 60 else climax_v61(r),
        "cross_down": truth((F.col("white_line") < F.col("yellow_line")) & (F.col("prev_white") >= F.col("prev_yellow"))),
    })


def _let(value: Column, body) -> Column:
    """Bind a value to a name inside a higher-order function."""
    return F.get(F.transform(F.array(value), body), 0)


def exit_reason(r: Rules, version: int, p: Column, b: Column, pnl: Column) -> Column:
    """Label of the exit taken on bar ``b`` with position ``p``, or null."""
    peak, hold = p["peak"], p["hold"]
    stop = pnl <= -(p["stop"] * p["atr"] / p["price"])
    climax = b["climax"] & (peak >= r.climax_peak)
    if version == 60:
        return (F.when(stop, "ATR_HARD_STOP")
                .when((peak >= r.trail_trigger) & (peak - pnl >= r.trail_drop), "TRAILING_TAKE")
                .when((peak >= r.keep_low) & (peak < r.keep_high) & (pnl <= r.keep_level), "BREAKEVEN_STOP")
                .when(climax, "BUY_CLIMAX")
                .when((hold >= r.idle_days) & (pnl <= r.idle_return), "TIME_STOP")
                .when(b["cross_down"], "DEATH_CROSS")
                .when(hold >= r.max_days, "MAX_HOLD"))
    hang = (b["close"] < p["line"]) & (hold >= r.hang_min_days)
    first = F.when(stop, "ATR_HARD_STOP").when(hang, "CHANDELIER_EXIT").when(climax, "BUY_CLIMAX")
    days = orders.by_score(p["score"], r.idle_days_by_score, r.idle_days) if version >= 64 else F.lit(r.idle_days)
    if version >= 63 and r.extend_from is not None:
        days = F.when(pnl * 100 >= r.extend_from, F.lit(r.extend_days)).otherwise(days)
    timed = F.when(((hold >= days) & (pnl < r.idle_return)) | (hold >= r.max_days) | b["cross_down"], "TIME_STOP")
    if version < 64:
        return F.coalesce(first, timed)
    if r.break_even:
        first = F.when((peak >= r.break_even_trigger) & (pnl <= r.break_even_level), "BREAKEVEN_STOP").otherwise(first)
    # Later rules may relabel an exit that was already decided; strict_order keeps the first label.
    late = F.coalesce(timed, first)
    if r.tiers:
        drop = F.when(peak >= 0.20, r.tier_drop[2]).when(peak >= 0.10, r.tier_drop[1]).otherwise(r.tier_drop[0])
        late = F.when(peak >= r.tier_from, F.when(peak - pnl >= drop, "PROFIT_TIER").otherwise(first)).otherwise(late)
    if r.early:
        late = F.when((hold >= r.early_days) & (pnl < r.early_return), "EARLY_EXIT").otherwise(late)
    return F.coalesce(first, late) if r.strict_order else late


def _step(r: Rules, version: int, signal: str):
    no_position = F.lit(None).cast(POSITION)

    def state(pending, position, trades):
        return F.struct(pending.alias("pending"), position.alias("position"), trades.alias("trades"))

    def step(acc: Column, b: Column) -> Column:
        price = b["fill"]
        hang0 = b["hang"]
        opened = F.struct(
            b["d"], price, b["atr"], b["size"], b["stop"], hang0, b["score"], b["code"], F.lit(0), F.lit(0.0), b["high"],
            F.greatest(F.lit(0.0), b["high"] - hang0 * b["atr"])).cast(POSITION)
        entered = state(F.lit(False), opened, acc["trades"])
        rejected = state(F.lit(False), no_position, acc["trades"])
        flat = state(b[signal], no_position, acc["trades"])

        p0 = acc["position"]
        top = F.greatest(p0["top"], b["high"])
        moved = F.struct(
            p0["entry_d"], p0["price"], p0["atr"], p0["shares"], p0["stop"], p0["hang"], p0["score"], p0["code"],
            p0["hold"] + 1, F.greatest(p0["peak"], (b["high"] - p0["price"]) / p0["price"]), top,
            F.greatest(p0["line"], top - p0["hang"] * p0["atr"])).cast(POSITION)

        def close_or_hold(p: Column) -> Column:
            pnl = (b["close"] - p["price"]) / p["price"]

            def decide(reason: Column) -> Column:
                trade = F.struct(p["entry_d"], b["d"], p["price"], b["close"], p["shares"], p["hold"], pnl * 100,
                                 p["peak"] * 100, reason, p["code"]).cast(TRADE)
                sold = state(F.lit(False), no_position,
                             F.array_append(acc["trades"], trade))
                return F.when(reason.isNull(), state(F.lit(False), p, acc["trades"])).otherwise(sold)

            return _let(exit_reason(r, version, p, b, pnl), decide)

        holding = _let(moved, close_or_hold)
        return (F.when(acc["pending"], F.when(b["can_enter"], entered)
                       .otherwise(rejected))
                .when(p0.isNull(), flat).otherwise(holding))

    return step


def fold_by_symbol(df: DataFrame, fields: list[Column], start: Column, step, finish) -> DataFrame:
    """Fold the rows of each symbol in time order; ``fields`` must start with the date.

    The extension hook for any stateful rule over bars: ``step(state, row)`` is a column
    expression, so the fold runs without Python workers.
    """
    return folds_by_symbol(df, fields, start, {"folded": step}, finish).select("sym", "folded")


def folds_by_symbol(df: DataFrame, fields: list[Column], start: Column, steps: dict, finish, *more: Column) -> DataFrame:
    """Several folds over the same ordered rows: (sym, bars, the aggregates ``more``, a column per step), one row a symbol."""
    rows = F.array_sort(F.collect_list(F.struct(*fields))).alias("bars")
    return df.groupBy("sym").agg(rows, *more).withColumns({name: F.aggregate("bars", start, step, finish) for name, step in steps.items()})


def folded_ledgers(df: DataFrame, r: Rules, version: int, signals: dict[str, str], allow: str | None = None, *more: Column) -> DataFrame:
    """One row a symbol with its closed trades as an array per entry of ``signals`` {name: signal column}.

    Ledgers that differ by their signal, and reports that need the folded ``bars`` or other aggregates (``more``) beside the
    trades, take them from here: the windows of the features run once for all of them.
    """
    df = entry_columns(df, r, version, next(iter(signals.values())), allow)
    wanted = [_allowed(signal, allow or "_allow", version).alias(f"sig_{name}") for name, signal in signals.items()]
    fields = [F.col("d"), F.col("high"), F.col("close"), F.col("fill"), F.col("size"), F.col("can_enter"),
              *wanted, F.col("climax"), F.col("cross_down"), F.col("prev_atr").alias("atr"),
              F.col("stop_multiple").alias("stop"), F.col("hang_multiple").alias("hang"),
              F.coalesce("entry_score", F.lit(0)).alias("score"), F.col("entry_code").alias("code")]
    start = F.struct(F.lit(False).alias("pending"), F.lit(None).cast(POSITION).alias("position"), F.lit([]).cast(f"array<{TRADE}>").alias("trades"))
    steps = {name: _step(r, version, f"sig_{name}") for name in signals}
    return folds_by_symbol(df, fields, start, steps, lambda acc: acc["trades"], *more)


def trade_ledger(df: DataFrame, r: Rules, version: int, signal: str, allow: str | None = None) -> DataFrame:
    """Closed trades per symbol. ``df`` carries indicators and signals; ``allow`` names a gate column."""
    return folded_ledgers(df, r, version, {"trades": signal}, allow).select("sym", F.inline("trades"))


def missing_from(trades: str, other: str) -> Column:
    """The trades of one array column whose symbol and buying date the other array lacks; unknown ones equal nothing."""
    def held(t: Column) -> Column:
        return F.col("sym").isNotNull() & F.coalesce(F.exists(other, lambda o: o["buy_date"] == t["buy_date"]), F.lit(False))

    return F.filter(trades, lambda t: ~held(t))
