"""Every operator as a query over the given tables, with the same question in plain SQL."""

from __future__ import annotations

import importlib

AREAS = ("parsing", "windows", "ingest", "history", "models", "streams")


def load() -> None:
    """Import all areas, which fills the registry."""
    for area in AREAS:
        importlib.import_module(f"checks.{area}")
