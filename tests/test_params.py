"""The rule sets written out: queries and oracles read the same sets, so a wrong value would be equally wrong on both sides."""

from __future__ import annotations

import pytest

from sparkbars import params

# Published settings of the models and the market regime.
V64 = dict(
    structure=True, structure_micro=True, smart_money=False, flow_lookback=8, flow_min_score=3, flow_up_return=0.015, flow_up_volume=1.10,
    flow_pullback_volume=0.90, flow_pullback_share=0.60, flow_dominance=1.20, flow_near_high=0.97, flow_heavy_volume=1.20, flow_heavy_drop=0.005,
    flow_heavy_days=0, quality=True, min_score=3, j_extreme=0, j_low=5, volume_extreme=0.30, volume_low=0.50, candle_shadow=2.0, candle_body=0.015,
    candle_cap=2, cross_lookback=3, converge_band=0.5, support_one=2, support_two=3, rising_lookback=5, rising_from_score=3,
    drop_weak_score4=False, persist=False, persist_conditions=3, persist_points=1, early=False, early_days=3, early_return=-0.05, idle_days=7,
    score_size={0: 0.7, 1: 0.7, 2: 0.7, 3: 1.0, 4: 1.0, 5: 1.2, 6: 1.3, 7: 1.5, 8: 1.5},
    idle_days_by_score={0: 5, 1: 5, 2: 5, 3: 7, 4: 7, 5: 8, 6: 9, 7: 10, 8: 10},
    break_even=True, break_even_trigger=0.03, break_even_level=0.005)


# What the tuned model changes.
BEST = V64 | dict(
    min_score=4, oversold=5, window=10, industry_top=0.20, j_extreme=3, drop_weak_score4=True, idle_return=0.0, idle_days=10, max_days=15,
    hang_band=2.8, dynamic_hang=(2.2, 2.7, 3.2), break_even_trigger=0.05, break_even_level=0.003, tiers=True, tier_from=0.05,
    tier_drop=(0.03, 0.08, 0.15))


@pytest.mark.parametrize("name", sorted(V64))
def test_structure_model(name):
    assert getattr(params.V64, name) == V64[name]


@pytest.mark.parametrize("name", sorted(BEST))
def test_tuned_model(name):
    assert getattr(params.BEST, name) == BEST[name]


def test_market_regime():
    assert params.REGIME["smooth"] == 15 and params.REGIME["cost"] == 42
    assert params.REGIME["upper"] == 2.0 and params.REGIME["lower"] == -1.0


def test_grid():
    """2,304 combinations before the guard."""
    assert params.GRID["smooth"] == [5, 8, 10, 13, 15, 20]
    assert params.GRID["cost"] == [13, 17, 21, 26, 34, 42]
    assert params.GRID["upper"] == [2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0]
    assert params.GRID["lower"] == [-1.0, -1.5, -2.0, -2.3, -2.5, -3.0, -3.5, -4.0]
