"""Registered queries and their independent SQL."""

from __future__ import annotations

import importlib
from dataclasses import dataclass

#: Modules that register queries when imported.
MODULES: tuple[str, ...] = ("recognize", "contextual", "importing", "placing")


@dataclass(frozen=True)
class Plans:
    queries: dict
    oracles: dict


def all_plans() -> Plans:
    from tarnhelm.plans import registry

    for name in MODULES:
        importlib.import_module(f"tarnhelm.plans.{name}")
    return Plans(registry.QUERIES, registry.ORACLES)
