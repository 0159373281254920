"""All SQL oracles."""

from __future__ import annotations

from oracle import features, ledgers, maintenance, market, operations, scan, streams

MODULES = [features, market, ledgers, maintenance, operations, scan, streams]


def oracle_sql() -> dict[str, str]:
    out = {}
    for module in MODULES:
        out.update(module.oracle_sql())
    return out
