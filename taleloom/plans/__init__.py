"""Named queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

_PARTS = ("text", "notes", "markup", "graph", "timeline", "registry_queries")


def _registered():
    for part in _PARTS:
        import_module(f"taleloom.plans.{part}")
    return import_module("taleloom.plans.registry")


def all_queries() -> dict:
    return dict(_registered().QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_registered().ORACLES)
