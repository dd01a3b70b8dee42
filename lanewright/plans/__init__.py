"""Domain views over the given tables and the named queries on them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("rows", "joins", "aggregates", "ordering", "choice", "remediation", "modelling", "storage")


def _load():
    for name in MODULES:
        import_module(f"lanewright.plans.{name}")
    from lanewright.plans import registry

    return registry


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_checks() -> dict:
    return dict(_load().CHECKS)
