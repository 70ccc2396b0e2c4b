"""Registered queries: each operator applied to whole tables."""

import importlib
import pkgutil

from tracewell.plans.registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _module != "registry":
        importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
