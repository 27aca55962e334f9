"""Queries bound to the driver's tables, each with SQL to compare against."""

import importlib
import pkgutil


def load():
    """Import every module with queries; return (queries, SQL by name)."""
    from checks import catalog
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"checks.{module.name}")
    return catalog.QUERIES, catalog.ORACLES
