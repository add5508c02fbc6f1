"""Registered queries; importing this package fills the registry."""

import importlib
import pkgutil

from pressgrain.plans.registry import ORACLES, QUERIES, resolve

for _info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
    if _info.name.startswith("q_"):
        importlib.import_module(f"{__name__}.{_info.name}")

resolve()

__all__ = ["ORACLES", "QUERIES"]
