"""Order pricing, fill decisions and position sizing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkbars.functions.windows import half_even
from sparkbars.params import Rules

# Slippage, price step and least volume ratio of a limit order.
SLIPPAGE, TICK, LEAST_VOLUME = 0.001, 0.01, 0.5


def limit_price(close: Column, slow: Column, atr: Column, r: Rules) -> Column:
    """Limit for the next bar: discounted close, not above the slow line, at most 2 ATR away."""
    return half_even(F.greatest(F.least(close * (1 - r.limit_discount), slow), close - 2.0 * atr), 2)


def limit_fill(limit: Column, open_: Column, low: Column, volume: Column, average: Column) -> Column:
    """Struct (filled, price, reason) of a limit order against the next bar."""
    gap_price = half_even(F.greatest(F.least(open_ * (1 + SLIPPAGE), limit), open_), 2)

    def result(filled, price, reason):
        return F.struct(F.lit(filled).alias("filled"), price.cast("double").alias("price"), F.lit(reason).alias("reason"))

    none = F.lit(0.0)
    return (F.when((limit <= 0) | (open_ <= 0) | (low <= 0), result(False, none, "invalid_data"))
            .when((average > 0) & (volume / average < LEAST_VOLUME), result(False, none, "not_filled_low_volume"))
            .when(open_ <= limit, result(True, gap_price, "gap_down_fill"))
            .when(low < limit - TICK, result(True, half_even(limit, 2), "intraday_fill"))
            .when(low <= limit, result(False, none, "not_filled_no_penetration"))
            .otherwise(result(False, none, "not_filled_gap_up")))


def limit_fill_simple(limit: Column, open_: Column, low: Column) -> Column:
    """Fill price, or null when the bar never reaches the limit."""
    return F.when(open_ <= limit, open_).when(low <= limit, limit)


def with_slippage(price: Column, side: str) -> Column:
    return half_even(price * (1 + SLIPPAGE if side == "buy" else 1 - SLIPPAGE), 2)


def lots(amount: Column) -> Column:
    """Whole lots of one hundred."""
    return F.floor(amount / 100) * 100


def fixed_shares(price: Column, r: Rules) -> Column:
    return lots(F.lit(r.cash * r.fixed_share) / price)


def parity_shares(price: Column, atr: Column, stop: Column, r: Rules) -> Column:
    """Shares that risk a fixed part of equity, within a band of position sizes."""
    loss = stop * atr
    wanted = F.lit(r.cash * r.risk_share) / F.nullif(loss, F.lit(0.0))
    low, high = F.lit(r.cash * r.min_share) / price, F.lit(r.cash * r.max_share) / price
    size = F.greatest(lots(F.least(F.greatest(wanted, low), high)), F.lit(0))
    return F.when((loss > 0) & price.isNotNull(), size).otherwise(0)


def by_score(score: Column, mapping, default) -> Column:
    """Value looked up by score; a plain CASE over the few map entries."""
    out = None
    for key, value in mapping.items():
        out = F.when(score == key, F.lit(value)) if out is None else out.when(score == key, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def scaled_shares(shares: Column, score: Column, r: Rules) -> Column:
    if not r.score_size:
        return shares
    return F.floor(shares * by_score(score, r.score_size, 1.0))
