"""All registered queries."""

from __future__ import annotations

from sparkbars.plans import features, ledgers, maintenance, market, operations, scan, streams

FLAGSHIP = "scan_all_dates"
MODULES = [features, market, ledgers, maintenance, operations, scan, streams]


def queries() -> dict:
    out = {}
    for module in MODULES:
        for name, make in module.queries().items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = make
    return out
