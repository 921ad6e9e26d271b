"""All queries of the reference's own operators and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ["operators.payments", "operators.layout", "operators.bounds", "operators.resampling", "operators.selection", "operators.epochs", "operators.probes", "operators.outcomes", "operators.integrity", "operators.arms", "operators.policy", "operators.rates", "operators.thresholds", "operators.rules", "operators.sequences", "operators.corpus", "operators.registers", "functions.scalars", "functions.text", "sources.files"]


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"ledgerlens.{name}"), what)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
