"""Query plans over the given tables, one module per group of operators."""
from __future__ import annotations

import importlib
import pkgutil


def load_all():
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        importlib.import_module(f"{__name__}.{m.name}")
    from tidegauge.plans.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
