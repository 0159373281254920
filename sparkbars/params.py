"""Rule sets for signals, scores, exits and market regime.

A rule set is a frozen dataclass resolved to literals while a plan is built.
Later model versions are derived from earlier ones with ``replace``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Mapping

# All thresholds below have to equal the published model settings.


@dataclass(frozen=True)
class Rules:
    # demand bar ("anchor") detection
    body_share: float = 0.50
    close_location: float = 0.60
    demand_vs_average: float = 0.75
    demand_vs_dry: float = 1.5
    support_band: float = 1.5
    overshoot_band: float = 3.0
    touch_band: float = 0.5
    dry_volume: float = 0.65
    test_volume: float = 1.2
    dragon_multiple: float = 200.0
    # quiet bar ("ambush") detection
    window: int = 5
    oversold: float = 13.0
    quiet_volume: float = 0.70
    quiet_body: float = 0.03
    quiet_support: float = 0.5
    # rebound check
    rebound: bool = False
    rebound_shadow: float = 1.0
    # micro confirmation
    micro: bool = False
    micro_all: bool = False
    micro_vwap: bool = True
    micro_inside: bool = False
    micro_shrink: bool = True
    micro_wick: bool = False
    # structure signal and quality filters
    structure: bool = False
    smart_money: bool = False
    quality: bool = False
    min_score: int = 3
    j_extreme: float = 0.0
    j_low: float = 5.0
    volume_extreme: float = 0.30
    volume_low: float = 0.50
    candle_shadow: float = 2.0
    candle_body: float = 0.015
    candle_cap: int = 2
    cross_lookback: int = 3
    converge_band: float = 0.5
    support_one: int = 2
    support_two: int = 3
    support_weights: tuple[int, ...] = (1, 1, 1, 1, 1)  # of the factors A to E
    support_gate: bool = False
    support_min: int = 1
    support_needs: str = ""  # factors that must be set, of "ad"
    structure_micro: bool = True
    persist: bool = False
    persist_conditions: int = 3
    persist_points: int = 1
    rising_lookback: int = 5
    rising_from_score: int = 3
    drop_weak_score4: bool = False
    # smart-money structure
    flow_lookback: int = 8
    flow_min_score: int = 3
    flow_up_return: float = 0.015
    flow_up_volume: float = 1.10
    flow_pullback_volume: float = 0.90
    flow_pullback_share: float = 0.60
    flow_dominance: float = 1.20
    flow_near_high: float = 0.97
    flow_heavy_volume: float = 1.20
    flow_heavy_drop: float = 0.005
    flow_heavy_days: int = 0
    # entry
    gap_limit: float = 1.5
    cash: float = 100000.0
    fixed_share: float = 0.3
    parity: bool = False
    risk_share: float = 0.01
    max_share: float = 0.15
    min_share: float = 0.05
    limit_order: bool = False
    limit_discount: float = 0.002
    score_size: Mapping[int, float] = field(default_factory=dict)
    # exits
    stop_band: float = 2.0
    trail_trigger: float = 0.15
    trail_drop: float = 0.05
    keep_low: float = 0.08
    keep_high: float = 0.15
    keep_level: float = 0.015
    idle_days: int = 8
    idle_return: float = -0.01
    idle_days_by_score: Mapping[int, int] = field(default_factory=dict)
    max_days: int = 20
    climax_volume: float = 2.5
    climax_return: float = 0.5
    climax_peak: float = 0.05
    climax_body: float = 0.02
    climax_shadow: float = 2.0
    hang_band: float = 3.0
    hang_min_days: int = 2
    extend_from: float | None = None
    extend_days: int = 20
    dynamic: bool = False
    dynamic_lookback: int = 60
    dynamic_low: float = 30.0
    dynamic_high: float = 70.0
    dynamic_stop: tuple = (2.0, 2.5, 3.0)
    dynamic_hang: tuple = (3.0, 3.5, 4.0)
    break_even: bool = False
    break_even_trigger: float = 0.03
    break_even_level: float = 0.005
    early: bool = False
    early_days: int = 3
    early_return: float = -0.05
    tiers: bool = False
    tier_from: float = 0.05
    tier_drop: tuple = (0.03, 0.06, 0.10)
    strict_order: bool = False
    # industry
    industry_days: int = 20
    industry_threshold: float = 0.0
    industry_top: float = 0.20
    # stock momentum
    momentum_floor: float = -0.03
    momentum_floor_bull: float = -0.05
    momentum_boost: int = 1
    revive_industry_score: int = 6
    revive_momentum_score: int = 7
    revive_j_score: int = 2
    # dynamic score filter
    bull_min_score: int = 4
    bear_min_score: int = 5
    score4_exception: bool = False
    score4_j_max: float = 8.0
    score4_volume_max: float = 0.70
    j_cap: float = 8.0


V60 = Rules()
V61 = replace(
    V60, oversold=18.0, quiet_volume=0.8, quiet_body=0.04, window=7, stop_band=2.5,
    idle_days=10, rebound=True, idle_return=0.01,
)
V62 = replace(V61, rebound=False, hang_band=2.5, idle_days=8, window=12)
V63 = replace(
    V62, hang_band=3.5, idle_days=10, extend_from=5.0, oversold=25.0, industry_days=10,
    industry_top=0.30, parity=True, micro=True, dynamic=True,
)
V64 = replace(
    V63, structure=True, quality=True, idle_days=7, break_even=True,
    score_size={0: 0.7, 1: 0.7, 2: 0.7, 3: 1.0, 4: 1.0, 5: 1.2, 6: 1.3, 7: 1.5, 8: 1.5},
    idle_days_by_score={0: 5, 1: 5, 2: 5, 3: 7, 4: 7, 5: 8, 6: 9, 7: 10, 8: 10},
)
BEST = replace(
    V64, min_score=4, oversold=5.0, window=10, industry_top=0.20, j_extreme=3.0,
    drop_weak_score4=True, idle_return=0.0, idle_days=10, max_days=15, hang_band=2.8,
    dynamic_hang=(2.2, 2.7, 3.2), break_even_trigger=0.05, break_even_level=0.003,
    tiers=True, tier_drop=(0.03, 0.08, 0.15),
)

# Subscription plans as (plan, days, grants signals, paid).
PLANS = [
    ("trial", 7, True, False),
    ("free", None, False, False),
    ("monthly", 30, True, True),
    ("quarterly", 90, True, True),
    ("yearly", 365, True, True),
    ("expired", 0, False, False),
]

# Market regime settings (smoothing, cost average, thresholds).
REGIME = dict(smooth=15, cost=42, upper=2.0, lower=-1.0, weekly_span=5)
GRID = dict(
    smooth=[5, 8, 10, 13, 15, 20],
    cost=[13, 17, 21, 26, 34, 42],
    upper=[2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0],
    lower=[-1.0, -1.5, -2.0, -2.3, -2.5, -3.0, -3.5, -4.0],
)
FINE_GRID = dict(
    smooth=[8], cost=[21],
    upper=[1.0 + 0.5 * i for i in range(15)],
    lower=[-0.5 - 0.5 * i for i in range(10)],
)
