"""The library's own queries (all but the training-data operators) and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from panelwright import plans
from panelwright.plans import base


def _load() -> None:
    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{plans.__name__}.{module.name}")


def queries() -> dict:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(base.ORACLES)
