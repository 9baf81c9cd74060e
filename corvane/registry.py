"""Name -> query and name -> DuckDB SQL, gathered from the modules of corvane.plans."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES: list[str] = ["texts", "web", "evidence", "systems", "measures", "checks", "exports"]


def queries() -> dict[str, Callable]:
    return {k: q for m in MODULES for k, q in import_module(f"corvane.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"corvane.plans.{m}").ORACLES.items()}
