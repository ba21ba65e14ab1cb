"""Registered queries with their oracles: each result written again in DuckDB SQL."""

from __future__ import annotations

MODULES = ("traffic", "alerts", "integration", "incidents", "quality", "roads", "matching", "studies", "evaluation", "interactive", "roundtrips")


def all_queries() -> tuple[dict, dict]:
    import importlib

    for name in MODULES:
        importlib.import_module(f"checks.{name}")
    from checks.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
