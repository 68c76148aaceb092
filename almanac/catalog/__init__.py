"""The registered queries over the shared test tables, each next to its DuckDB check."""

from __future__ import annotations

from importlib import import_module

MODULES = ["projections", "aggregates", "joins", "rolling", "ranked", "stored", "models", "arriving"]


def load() -> tuple[dict, dict]:
    """All queries and checks, keyed by inventory id and name."""
    for name in MODULES:
        import_module(f"almanac.catalog.{name}")
    from almanac.catalog.panels import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
