"""Collects the queries of all modules."""

from __future__ import annotations

from importlib import import_module

from tickforge import registry

MODULES = ("scans", "joins", "features", "evaluation", "portfolio", "feeds", "extra", "artifacts")


def register() -> None:
    for module in MODULES:
        for name, (query, oracle) in import_module(f"tickforge.plans.{module}").QUERIES.items():
            registry.add(name, query, oracle)
