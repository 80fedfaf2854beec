"""All registered queries and their oracles."""
from __future__ import annotations

import importlib

from vacancia.plans.registry import Query

_MODULES = ("feed", "discovery", "health", "metrics", "matching", "evaluation", "streams")


def _registries():
    for name in _MODULES:
        yield getattr(importlib.import_module(f"vacancia.plans.{name}"), name)


def queries() -> dict[str, Query]:
    return {k: v for r in _registries() for k, v in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in _registries() for k, v in r.oracles.items()}
