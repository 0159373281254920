"""Registered queries against their SQL oracles on the smallest data set.

A selection over all families by default; SPARKBARS_ALL=1 checks every query at sf0.01.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

EVERY = bool(os.environ.get("SPARKBARS_ALL"))
ROOT = "/root/testdata/sf0.01" if EVERY else "/root/testdata/sf0.001"
SELECTION = """ind_sma ind_kdj signal_v64_best dynamic_stop_params market_amv regime_allowed regime_summary industry_rs_rank
crash_guard asof_nearest_momentum limit_fill ledger_v60 ledger_v64_best ledger_breakdown_rollup incremental_merge
splice_realtime_bar clean_jump_rows normalize_codes trading_calendar ops_report subscription_upgrade push_idempotent
signal_record scan_all_dates stream_ohlcv_bars stream_dedup""".split()
NAMES = sorted(entry.oracle_sql()) if EVERY else SELECTION


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


def test_every_query_has_an_oracle():
    from oracle import registry as oracle_registry
    from sparkbars.plans import registry

    assert set(registry.queries()) == set(oracle_registry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_oracle(spark, con, name):
    result = compare(spark, con, ROOT, name, entry.queries()[name], entry.oracle_sql()[name])
    assert result["ok"], result["problems"]


def test_entry_runs(spark):
    assert "momentum_tag" in entry.entry(spark).columns


def test_hot_symbol_is_combined_before_the_shuffle(spark):
    """Trades meet a partial aggregation before the exchange, so a hot symbol does not travel row by row."""
    from sparkbars.sources import views

    plan = views.derived_bars(spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "SortAggregate" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    from sparkbars.sources import views

    plan = views.derived_bars(spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_tax" not in plan


def test_a_query_reads_the_trades_once_at_most(spark):
    """Bars and the market series are tables: whatever a plan does with them, it does not scan the trades again."""
    for name in ("daily_scan", "scan_all_dates", "industry_allow_rs", "regime_allowed", "ledger_v62", "crash_guard"):
        plan = entry.queries()[name](spark, ROOT)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_extendedprice" not in plan, name
