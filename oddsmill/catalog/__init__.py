"""Every query over the test tables, with the SQL it is checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("series", "ingest", "trading", "monitoring", "streaming", "loads")


def load():
    from oddsmill.catalog import registry

    for module in MODULES:
        import_module(f"oddsmill.catalog.{module}")
    return registry.QUERIES, registry.ORACLES
