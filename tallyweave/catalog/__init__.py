"""All registered queries."""

from __future__ import annotations

import importlib

from .base import REGISTRY, Query

MODULES = ("core", "norm", "ledger", "pages")


def load() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return REGISTRY
