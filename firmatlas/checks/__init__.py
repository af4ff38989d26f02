"""Registered queries over the test tables, each with an equivalent SQL text."""

from __future__ import annotations

from importlib import import_module

MODULES = ["market", "lookup", "loading", "filings", "reports"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"firmatlas.checks.{name}"), attribute))
    return merged


def registered_queries() -> dict:
    return _merged("QUERIES")


def registered_sql() -> dict:
    return _merged("ORACLE")
