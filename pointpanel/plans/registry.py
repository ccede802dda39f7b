"""All registered queries and the oracle SQL that checks them."""

from __future__ import annotations

import importlib

SECTIONS = ["screens", "series", "backtests", "reference_data", "storage", "vocabulary"]


def _collect(attr: str) -> dict:
    out: dict = {}
    for section in SECTIONS:
        part = getattr(importlib.import_module(f"pointpanel.plans.{section}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")
