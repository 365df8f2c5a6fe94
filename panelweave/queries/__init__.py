"""Named queries over the driver's tables, each with equivalent SQL where SQL can state it."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLE, QUERIES

for _name in ("sources", "shape", "joining", "aggregates", "windows", "measures", "estimators", "inference", "study", "extended"):
    import_module(f"{__name__}.{_name}")

__all__ = ["QUERIES", "ORACLE"]
