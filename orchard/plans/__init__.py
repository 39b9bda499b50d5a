"""Registry of all workflow queries (Spark) and their DuckDB oracles."""

from __future__ import annotations

import importlib

PLAN_MODULES = [
    "census", "housing", "fraud", "population", "movies", "homes", "election",
    "reviews", "retrieval", "prices", "io",
]


def _modules():
    mods = []
    for name in PLAN_MODULES:
        try:
            mods.append(importlib.import_module(f"orchard.plans.{name}"))
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"orchard.plans.{name}":
                raise
    return mods


def all_queries() -> dict:
    out: dict = {}
    for m in _modules():
        for k, v in m.QUERIES.items():
            if k in out:
                raise KeyError(f"duplicate query key {k}")
            out[k] = v
    return out


def all_oracles() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(getattr(m, "ORACLE", {}))
    return out
