"""Loads every registered query."""

from __future__ import annotations

import importlib

from claimlens.plans.registry import ORACLES, QUERIES

MODULES = ["articles", "updates", "scans", "text", "spo", "graphs", "features", "models", "statistics", "pages", "augment", "streams"]


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"claimlens.plans.queries_{name}")
    return dict(QUERIES), dict(ORACLES)
