"""The registered queries, by importing the modules that register them."""

import importlib

from colophon.plans.inputs import ORACLES, QUERIES

MODULES = ["tables", "catalog", "vectors", "text", "web", "library"]

for _name in MODULES:
    importlib.import_module(f"colophon.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
