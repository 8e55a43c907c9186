"""Registered queries: one module per group of operators."""

from __future__ import annotations

import importlib
from typing import NamedTuple

MODULES = ["scalars", "filters", "joins", "stats", "ordered", "sets", "quality", "extraction",
           "publishing", "usage", "streams"]


class Registry(NamedTuple):
    queries: dict
    oracles: dict


def load() -> Registry:
    from slotatlas.plans import registry
    for name in MODULES:
        importlib.import_module(f"slotatlas.plans.{name}")
    return Registry(registry.QUERIES, registry.ORACLES)
