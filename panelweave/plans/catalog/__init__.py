"""Registered queries: every operator on the driver's tables, with the same query as SQL."""

from __future__ import annotations


def all_entries() -> dict[str, tuple]:
    import importlib

    merged: dict[str, tuple] = {}
    for name in MODULES:
        merged.update(importlib.import_module(f"panelweave.plans.catalog.{name}").ENTRIES)
    return merged


MODULES = ["data", "signals", "backtest", "runs", "corpus"]
