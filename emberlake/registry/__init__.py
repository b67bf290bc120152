"""Queries offered to the driver, grouped by subject."""

from __future__ import annotations

import importlib

MODULES = ["civil", "quality", "osint", "reconcile", "areas", "roads", "feeds", "derived", "intake", "enrichment", "sync", "streams", "surface"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"emberlake.registry.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLE")
