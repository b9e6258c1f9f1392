"""Operators on texts for training data, one module per problem; nothing outside imports them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("align", "copies", "forms", "leaks", "pairs", "pieces", "residue", "scans", "tokens")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__name__}.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
