"""Every operator as a query on the test tables, next to equivalent SQL."""

from __future__ import annotations

import importlib
import pkgutil

from clickloom.catalog import registry


def load():
    """Import all query modules; returns the queries and their SQL."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLE
