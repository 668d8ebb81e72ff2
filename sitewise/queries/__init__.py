"""Registered queries: each pairs a Spark job on the given tables with its SQL."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES = ("rows", "stays", "series", "sites", "resampling", "sinks", "fits")


def load() -> ModuleType:
    """The register with the queries of all modules."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
