"""Queries over the given tables, one per operator."""

from __future__ import annotations

from importlib import import_module

from closeline.plans import registry

MODULES = ("prices", "selection", "statistics", "boards", "schedules", "history", "players", "ledgers", "sources", "models", "streams")


def _load() -> None:
    for name in MODULES:
        import_module(f"closeline.plans.{name}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
