"""Registered queries, one module per family of the blueprint."""

from __future__ import annotations

import importlib
import pkgutil

from plumbline.registry import QUERIES


def load():
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES
