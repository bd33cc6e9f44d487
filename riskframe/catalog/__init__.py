"""All registered queries over the test tables."""

from __future__ import annotations

from importlib import import_module

from riskframe.catalog.registry import ORACLES, QUERIES, Query

MODULES = ("features", "reports", "quality", "fitting", "evaluation", "operations", "scoring", "models")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and checking SQL by name."""
    for module in MODULES:
        import_module(f"riskframe.catalog.{module}")
    return QUERIES, ORACLES
